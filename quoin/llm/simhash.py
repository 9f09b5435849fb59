"""SimHash near-duplicates by pigeonhole blocks, and connected components.

Two fingerprints of 64 bits that differ in at most k bits agree in at least 3 of k + 3 blocks. Each distinct
fingerprint is therefore dealt to every choice of 3 blocks, under those blocks' bits as key; within a key the
Hamming distance is verified. A task walks its keys in sorted order and emits a spanning forest of each key's
links (each member is linked to the one that found it), never all pairs. A key with more than `split` members is
handed on: its members are dealt anew by blocks that cut across the old ones, `levels` times at most, so a key of
the last level leaves few bits open, whatever the input.

Components are found on fingerprints and carry their least document along, so nothing is ever gathered by
component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import DOCUMENTS, cut, pick, read
from quoin.llm.lookup import Rows


@dataclass(frozen=True)
class SimHash:
    words: int = 4
    bits: int = 4
    seed: int = 42
    split: int = 1 << 15
    levels: int = 4
    hub: int = 1 << 16  # links of one fingerprint that one task looks up


def fingerprint(text: str | None, p: SimHash, step: int = 1 << 16) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes. ASCII letters are lower-cased, words end at
    ASCII white space; a text without words has fingerprint zero. Shingles are hashed `step` at a time."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - p.words + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, step):
        part = words[a : min(len(words), a + step + p.words - 1)]
        if len(part) < p.words:
            shingles = [b" ".join(part)]
        else:
            shingles = map(b" ".join, zip(*(part[i:] for i in range(p.words)), strict=False))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(p.seed)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, p: SimHash) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. Null texts count as empty."""

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, p) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return pick(docs, DOCUMENTS).mapInArrow(hash_all, "doc_id bigint, fp bigint")


def _block_keys(fp: Column, widths: list[int], choose: int) -> Column:
    """For each choice of blocks: its number and those blocks' bits in one long."""
    starts = [sum(widths[:i]) for i in range(len(widths))]
    block = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("bigint")) for s, w in zip(starts, widths, strict=True)]
    keys = []
    for number, chosen in enumerate(combinations(range(len(widths)), choose)):
        bits = F.lit(number).cast("bigint")
        for i in chosen:
            bits = F.shiftleft(bits, widths[i]).bitwiseOR(block[i])
        keys.append(bits)
    return F.array(*keys)


def _refine(widths: list[int], choose: int, level: int):
    """Deals rows (key, fp) anew: the bits are put in another order for each level (by odd steps modulo 64), which
    keeps Hamming distances and lets the new blocks cut across the old; each choice of them is hashed with the old
    key."""
    order = np.argsort(np.arange(64) * (8 * level + 1) % 64)
    parts = np.split(order, np.cumsum(widths)[:-1])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp = np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)).view(np.uint64)
            masks = [np.bitwise_or.reduce(np.uint64(1) << part.astype(np.uint64)) for part in parts]
            for number, chosen in enumerate(combinations(range(len(widths)), choose)):
                bits = fp & np.bitwise_or.reduce([masks[i] for i in chosen])
                finer = _mix(_mix(key + np.uint64(number)) ^ bits)
                yield pa.RecordBatch.from_arrays([pa.array(finer.view(np.int64)), b.column(1)], ["key", "fp"])

    return deal


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection: multipliers and shifts are fixed values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _widths(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def forest(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: whoever is found is compared only with those
    not found yet."""
    left, right, rest = [], [], members
    while rest.size > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                found = rest[near]
                left.append(np.full(found.size, x))
                right.append(found)
                todo.extend(found)
                rest = rest[~near]
    empty = np.zeros(0, members.dtype)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _walk(bits: int, split: int | None):
    """Over rows (key, fp) sorted by both: links (a, b), and (key, fp) with hot = true for keys over `split`."""

    def out(a, b, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

    def run(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole keys only."""
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[new, keys.size])
        two = new[sizes == 2]
        x, y = fps[two], fps[two + 1]
        near = np.bitwise_count(x ^ y) <= bits
        lefts, rights = [x[near]], [y[near]]
        for at, size in zip(new[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            a, b = forest(fps[at : at + size], bits)
            lefts.append(a)
            rights.append(b)
        yield out(np.concatenate(lefts), np.concatenate(rights), False)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for b in batches:
            k, f = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)
            if hot is not None:  # the rest of a key that is too large
                same = int(np.searchsorted(k, hot, "right"))
                yield out(k[:same], f[:same], True)
                k, f = k[same:], f[same:]
                if not k.size:
                    continue
                hot = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            last = int(np.searchsorted(keys, keys[-1])) if keys.size else 0
            if split and keys.size - last > split:
                hot = keys[-1]
                yield out(keys[last:], fps[last:], True)
                keys, fps = keys[:last], fps[:last]
                last = keys.size
            if last:
                yield from run(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        if keys.size:
            yield from run(keys, fps)

    return walk


def links(fps: DataFrame, p: SimHash) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` with at most p.bits differing bits; enough of them that
    their components are those of all such links."""
    widths = _widths(64, p.bits + 3)
    dealt = fps.select(F.explode(_block_keys(F.col("fp"), widths, 3)).alias("key"), "fp")
    out, schema = [], "a bigint, b bigint, hot boolean"
    for level in range(1, p.levels + 1):
        walk = _walk(p.bits, p.split if level < p.levels else None)
        found = cut(dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(walk, schema))
        out.append(found.filter("not hot").select("a", "b"))
        hot = found.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
        if level == p.levels or hot.isEmpty():
            break
        dealt = hot.mapInArrow(_refine(widths, 3, level), "key bigint, fp bigint")
    return reduce(DataFrame.unionByName, out).distinct()


def components(nodes: DataFrame, edges: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """nodes: fp and first, edges: a and b. Every node with `least`, the struct (nameless, first, fp) that is the
    least in its component: nodes whose `first` is null come last.

    Labels take the least of the neighbours' and then that label's own; each round is a written table. A node with
    more than p.hub links, or more than a 50,000th of all, is looked up under several salts, so its links are
    dealt to many tasks; there are at most 100,000 such nodes, which is what is broadcast."""
    own = F.struct(F.col("first").isNull().alias("nameless"), "first", "fp")
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
    degrees = both.groupBy("b").agg(F.count("*").alias("n"))
    most = max(p.hub, (2 * edges.count() + 49_999) // 50_000)
    hubs = cut(degrees.filter(F.col("n") > most).select(F.col("b").alias("hub"), F.ceil(F.col("n") / most).cast("int").alias("salts")))
    salted = both.join(F.broadcast(hubs), F.col("b") == F.col("hub"), "left")
    both = cut(salted.select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts").cast("bigint")), F.lit(0)).cast("int").alias("salt")))
    linked = degrees.select(F.col("b").alias("fp"))
    labels = cut(nodes.join(linked, "fp").select("fp", own.alias("l")))
    while True:
        spread = labels.join(F.broadcast(hubs), F.col("fp") == F.col("hub"), "left")
        seen = spread.select(F.col("fp").alias("b"), "l", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        nearest = both.join(seen, ["b", "salt"]).groupBy(F.col("a").alias("fp")).agg(F.min("l").alias("m"))
        lower = labels.join(nearest, "fp").select("fp", "l", F.least("l", "m").alias("to"))
        # a root's label is its own: the many that point at one need no look at it
        steps = labels.filter("l.fp <> fp").select(F.col("fp").alias("via"), F.col("l").alias("further"))
        jumped = lower.join(steps, F.col("to.fp") == F.col("via"), "left").select("fp", F.least("to", "further").alias("new"), "l")
        labels = cut(jumped.select("fp", F.col("new").alias("l"), (F.col("new") < F.col("l")).alias("moved")))
        done = labels.filter("moved").isEmpty()
        labels = labels.select("fp", "l")
        if done:
            break
    rest = nodes.join(labels, "fp", "left")
    return rest.select("fp", F.coalesce("l", own).alias("least"))


def _least(distinct: DataFrame, p: SimHash) -> DataFrame:
    """distinct: fp, first (its least doc_id) and more. Adds `least`, its component's (nameless, first, fp)."""
    distinct = cut(distinct)
    return distinct.join(components(distinct.select("fp", "first"), cut(links(distinct.select("fp"), p)), p), "fp")


def near_duplicates(docs: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Texts are linked through their fingerprints, so any number of copies is one node. Null texts count as empty;
    all texts without words share fingerprint zero. Texts of any length are hashed whole, each in one task, some
    shingles at a time. Rows without doc_id take part; component_id is the smallest doc_id that is not null, null
    where a component has none. Rows that repeat a doc_id count by their texts, each in its component. An empty
    table gives no rows."""
    rows = cut(fingerprints(docs, p))
    named = _least(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), p).select("fp", F.col("least.first").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """One row of each component, with all columns: that with the smallest doc_id, of equals that with the smallest
    fingerprint, then the first read. Rows without doc_id come after all others, so one stays only where a
    component has no id.

    Null and empty texts are of one component, as in `near_duplicates`, and repeated rows are copies. An empty
    table stays empty. The rows are written once with a number each; which numbers stay is worked out on narrow
    columns and looked up task by task, so texts are not shuffled."""
    keyed = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    text, doc_id = (F.col(f"_{docs.columns.index(c)}").cast(t) for c, t in (("text", "string"), ("doc_id", "bigint")))
    whole = cut(keyed.withColumn("_fp", _fp_udf(p)(text)).withColumn("_row", F.monotonically_increasing_id()))
    best = F.min(F.struct(doc_id.isNull().alias("nameless"), doc_id.alias("doc_id"), "_row")).alias("best")
    named = _least(whole.groupBy(F.col("_fp").alias("fp")).agg(F.min(doc_id).alias("first"), best), p)
    chosen = Rows(named.filter("fp = least.fp").select("best._row"))
    return chosen.keep(whole, "_row").select(*keyed.columns).toDF(*docs.columns)


def _fp_udf(p: SimHash):
    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, p) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return fp


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
