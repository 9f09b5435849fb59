"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws -ln(u) / weight, u being hashed from the document's key and the child's path;
the smallest draw wins. A child wins in proportion to its weight, and a changed weight moves rows only into or
out of its own subtree. A node's weight is the sum of its shards'. A new shard opens a region of its own
(`grown`): no other subtree's weight changes, so it takes rows only into itself. Adding it to an old rack would
also move rows among that region's other shards.

Built-in functions only: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import DOCUMENTS, pick, read, running_total


@dataclass(frozen=True)
class Tree:
    """Shards as (region, rack, shard, weight)."""

    shards: tuple[tuple[int, int, int, float], ...]

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> Tree:
        return Tree(tuple((i // (racks * shards), i // shards % racks, i, 1.0) for i in range(regions * racks * shards)))

    def grown(self, weight: float = 1.0) -> Tree:
        region, shard = max(s[0] for s in self.shards) + 1, max(s[2] for s in self.shards) + 1
        return Tree((*self.shards, (region, 0, shard, weight)))

    def children(self) -> dict[str, dict[int, float]]:
        """The children and their weights of each path: '', 'region' and 'region/rack'."""
        out: dict[str, dict[int, float]] = {}
        for region, rack, shard, weight in self.shards:
            if weight <= 0:
                continue
            for path, child in (("", region), (f"{region}", rack), (f"{region}/{rack}", shard)):
                node = out.setdefault(path, {})
                node[child] = node.get(child, 0.0) + weight
        return out


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def _hashed(text: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("bigint")


def _winner(key: Column, tree: Tree, path: Column) -> Column:
    """The child of `path` with the smallest draw; of equal draws the smallest number."""
    table = F.create_map(
        *(x for at, kids in tree.children().items() for x in (F.lit(at), F.array(*(F.struct(F.lit(i).alias("id"), F.lit(w).alias("w")) for i, w in kids.items()))))
    )

    def draw(child: Column) -> Column:
        u = (_hashed(F.concat(key, F.lit("|"), path, F.lit("/"), child["id"].cast("string")), 1, 13) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.ln(u) / child["w"]).alias("draw"), child["id"].alias("id"))

    return F.array_min(F.transform(F.element_at(table, path), draw))["id"]


def place(docs: DataFrame, tree: Tree, grown: Tree, blocks: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack of every row.

    Null and empty texts have no bytes, and of a text of any length only its size and checksum go on; a null doc_id
    hashes like the text "null"; repeated rows go to the same shard, to slots of their own. Slots run over `blocks`
    hash blocks of a shard and by doc_id, size and checksum within, so no task sorts a whole shard; rows equal in
    all of these are equal. Of equal draws the child with the least number wins. An empty table gives no rows."""
    docs = pick(docs, DOCUMENTS)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _key(F.col("doc_id")).alias("_key"))
    for names, t in ((("region", "rack", "shard"), tree), (("_r", "_k", "grown_shard"), grown)):
        # level by level: a nested expression would hash the levels above anew for each child
        for level, name in enumerate(names):
            path = F.lit("") if not level else F.concat_ws("/", *(F.col(n).cast("string") for n in names[:level]))
            keyed = keyed.withColumn(name, _winner(F.col("_key"), t, path))
    keyed = keyed.withColumn("_block", _hashed(F.col("_key"), 14, 4) % blocks).withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_total(keyed, ["shard"], "_block", ["doc_id", "size", "text_crc32"], "_one", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def sql(tree: Tree, grown: Tree, blocks: int = 256) -> str:
    """The same in DuckDB's SQL; crc32 is folded over the bytes with a table made from its polynomial."""

    def descent(name: str, t: Tree) -> str:
        values = ", ".join(f"('{path}', {child}, {w})" for path, kids in t.children().items() for child, w in kids.items())
        draw = "-ln((('0x' || substr(md5(k || '|' || path || '/' || child), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE) / w"
        pick = f"arg_min(child, {{'d': {draw}, 'c': child}})"
        return f"""{name} AS (SELECT * FROM (VALUES {values}) v(path, child, w)),
{name}1 AS (SELECT k, {pick} AS a FROM keys, {name} WHERE path = '' GROUP BY k),
{name}2 AS (SELECT k, a, {pick} AS b FROM {name}1 JOIN {name} ON path = a::VARCHAR GROUP BY k, a),
{name}3 AS (SELECT k, a, b, {pick} AS c FROM {name}2 JOIN {name} ON path = a || '/' || b GROUP BY k, a, b)"""

    return f"""WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
raw AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, encode(coalesce(text, '')) AS b FROM documents),
sums AS (SELECT doc_id, k, CAST(octet_length(b) + 8 AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(list_prepend(4294967295,
  list_transform(regexp_extract_all(hex(b), '..'), lambda p: ('0x' || p)::INTEGER)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS BIGINT) AS text_crc32 FROM raw, tab),
keys AS (SELECT DISTINCT k FROM raw),
{descent("old", tree)},
{descent("new", grown)}
SELECT doc_id, size, text_crc32, 'key' AS law, old3.c AS shard, row_number() OVER (PARTITION BY old3.c ORDER BY ('0x' || substr(md5(k), 14, 4))::BIGINT % {blocks},
  doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, new3.c AS grown_shard, old3.a AS region, old3.b AS rack
FROM sums JOIN old3 USING (k) JOIN new3 USING (k)"""


TREE = Tree.even(2, 3, 4)
OP10_SQL = sql(TREE, TREE.grown())


def op10_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(read(spark, sf_dir, "documents"), TREE, TREE.grown())
