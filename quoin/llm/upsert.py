"""Copy-on-write upsert by key into a table of sorted Parquet files.

The table's files follow each other in the order of a whole-number key. A change belongs to one file, its home: the last
that begins at or below its key. Only homes whose rows really differ afterwards are written anew; all others stay as
they are.

Rows get their place by a global range sort: a row's number is its place in its partition plus the sizes of the
partitions before it, and its file follows from the number by arithmetic. What the driver and broadcasts hold is a few
numbers for each file of the table (no more than MOST_FILES) and for each partition of the sort.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quoin.llm.common import cut, filesystem, pick, read, shared_dir

MOST_FILES = 1 << 20
LEAST = -(1 << 63)
SET, DELETE, IGNORE = "set", "delete", "ignore"


@dataclass(frozen=True)
class Table:
    folder: str
    schema: StructType
    key: str
    rows_per_file: int


@dataclass(frozen=True)
class File:
    path: str
    first: int | None
    last: int | None
    rows: int


def first_of_each_name(df: DataFrame) -> DataFrame:
    """All columns in order; of those whose names are equal but for case, the first."""
    names = [c.lower() for c in df.columns]
    at = df.toDF(*(f"_{i}" for i in range(len(names))))
    return at.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(df.columns) if names.index(c.lower()) == i))


def _numbers(values: list[int], at: Column) -> Column:
    """values[at], the list being one constant of the plan."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), at.cast("int"))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows, written in global order, with `_no` from 0: their place in that order."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)], dtype=np.int64)])
    return placed.withColumn("_no", _numbers(starts.tolist(), part) + place).drop("_at")


def _write(rows: DataFrame, file: Column, n_files: int, table: Table) -> None:
    """Adds `n_files` files; `file` numbers them, and the rows of each are written by a task of their own."""
    if n_files > MOST_FILES:
        raise ValueError(f"{n_files} files: more than {MOST_FILES}, use more rows a file")
    if n_files:
        dealt = rows.withColumn("_file", file.cast("int")).repartitionById(n_files, "_file").sortWithinPartitions("_no")
        dealt.select(*table.schema.names).write.mode("append").option("maxRecordsPerFile", 0).parquet(table.folder)


def create(rows: DataFrame, folder: str, key: str, rows_per_file: int) -> Table:
    """Writes the rows, sorted by key (null first, equal keys by the other columns), as files of `rows_per_file` rows
    (the last: the rest). No rows give no files."""
    rows = first_of_each_name(rows)
    table = Table(folder, rows.schema, key, rows_per_file)
    placed = numbered(rows, [key, *(c for c in rows.columns if c != key)])
    _write(placed, F.floor(F.col("_no") / F.lit(rows_per_file)), -(-placed.count() // rows_per_file), table)
    return table


def files(table: Table, spark: SparkSession) -> list[File]:
    """The table's files in order, with their least and greatest keys."""
    rows = spark.read.schema(table.schema).parquet(table.folder) if _exists(spark, table.folder) else spark.createDataFrame([], table.schema)
    if table.folder and not rows.inputFiles():
        return []
    own = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(table.key).alias("first"), F.max(table.key).alias("last"), F.count("*").alias("n"))
    found = [File(r.path, r.first, r.last, r.n) for r in own.limit(MOST_FILES + 1).collect()]
    if len(found) > MOST_FILES:
        raise ValueError(f"{table.folder}: more than {MOST_FILES} files, use more rows a file")
    least = lambda x: LEAST if x is None else x
    return sorted(found, key=lambda f: (least(f.first), least(f.last), f.path))


def _path(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def _exists(spark: SparkSession, path: str) -> bool:
    fs, name = _path(spark, path)
    return fs.exists(name)


def with_homes(changes: DataFrame, key: str, known: list[File]) -> DataFrame:
    """Adds `_home` (the number of the change's file), `_low` (of the first file that may hold its key, repeated keys
    may lie in several) and `_first` (the least key of the home, null if there is no file)."""
    least = lambda x: LEAST if x is None else x
    fences = np.array([[least(f.first), least(f.last)] for f in known] or [[LEAST, LEAST]], np.int64)
    held = changes.sparkSession.sparkContext.broadcast(fences)

    @F.arrow_udf("struct<home: int, low: int, first: bigint>")
    def find(keys: pa.Array) -> pa.Array:
        firsts, lasts = held.value[:, 0], held.value[:, 1]
        k = keys.to_numpy(zero_copy_only=False)
        home = np.maximum(np.searchsorted(firsts, k, "right") - 1, 0)
        low = np.minimum(np.searchsorted(lasts, k, "left"), home)
        first = firsts[home]
        return pa.StructArray.from_arrays([pa.array(home, pa.int32()), pa.array(low, pa.int32()), pa.array(first, pa.int64(), mask=first == LEAST)], ["home", "low", "first"])

    found = changes.withColumn("_f", find(key))
    return found.select(*changes.columns, F.col("_f.home").alias("_home"), F.col("_f.low").alias("_low"), F.col("_f.first").alias("_first"))


def winners(changes: DataFrame, key: str, newest: list[str]) -> DataFrame:
    """A row for each key: the greatest by `newest` (null least), of equals by the other columns. Spark keeps one row
    a key in each task before it shuffles, so a key with very many changes is no burden."""
    rest = [c for c in changes.columns if c not in (key, *newest)]
    order = Window.partitionBy(key).orderBy(*(F.desc(c) for c in [*newest, *rest]))
    return changes.filter(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def planned(sizes: list[int | None], most: int) -> tuple[list[int], int]:
    """sizes: of each home in order its rows now, None if it stays as it is. The sizes of the files to be written: a
    home's as few as hold it and near equal, larger first; then each joins its left neighbour where both are new and
    fit into one file. Also the number of homes left without rows."""
    out: list[int | None] = []
    for n in sizes:
        if n is None:
            out.append(None)
            continue
        k = -(-n // most)
        for i in range(k):
            size = n // k + (i < n % k)
            if out and out[-1] is not None and out[-1] + size <= most:
                out[-1] += size
            else:
                out.append(size)
    return [n for n in out if n is not None], sum(n == 0 for n in sizes)


def upsert(spark: SparkSession, table: Table, changes: DataFrame, newest: list[str], values: list[str], decide: Callable[[Column], Column]) -> set[str]:
    """Applies the newest change of each key to the table and returns the names of the files that stayed as they were.

    decide(first): 'set', 'delete' or 'ignore' from the change's columns and the least key of its home. 'set' gives
    `values` to all rows of the key, or inserts one row whose other columns are null; 'delete' removes all rows of
    the key. Changes with a null key do nothing. In a table without files all changes have one home, without a first key.

    New files are added before old ones are deleted: a run that stops in between leaves both, and no row is lost."""
    key, columns = table.key, table.schema.names
    known = files(table, spark)
    homed = with_homes(winners(changes, key, newest), key, known)
    todo = cut(homed.withColumn("_do", decide(F.col("_first"))).filter(F.col("_do").isin(SET, DELETE)))
    touched = sorted(r[0] for r in todo.select(F.explode(F.sequence("_low", "_home"))).distinct().collect())  # numbers of files
    if known and touched:
        paths = [known[i].path for i in touched]
        numbers = spark.createDataFrame([(known[i].path, i) for i in touched], "_path string, _of int")
        rows = spark.read.schema(table.schema).parquet(*map(unquote, paths)).select("*", F.col("_metadata.file_path").alias("_path"))
        rows = rows.join(F.broadcast(numbers), "_path").drop("_path")  # MOST_FILES rows at most
    else:
        rows = spark.createDataFrame([], table.schema).withColumn("_of", F.lit(0))
    new = todo.select(F.col(key).alias("_key"), "_home", "_do", *(F.col(v).cast(table.schema[v].dataType).alias(f"_new_{v}") for v in values))
    both = rows.withColumn("_old", F.lit(True)).join(new, F.col(key) == F.col("_key"), "full_outer")
    old, sets = F.col("_old").isNotNull(), F.coalesce(F.col("_do") == SET, F.lit(False))
    drops = F.coalesce(F.col("_do") == DELETE, F.lit(False))
    other = reduce(lambda a, b: a | b, (~F.col(v).eqNullSafe(F.col(f"_new_{v}")) for v in values), F.lit(False))
    after = {c: F.when(sets, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in values else F.coalesce(c, "_key") if c == key else F.col(c) for c in columns}
    merged = cut(
        both.select(
            *(x.alias(c) for c, x in after.items()), F.coalesce("_of", "_home").alias("_of"),
            ((old | sets) & ~drops).alias("_stays"), ((old & drops) | (sets & (~old | other))).alias("_differs"),
        )
    )
    homes = merged.groupBy("_of").agg(F.bool_or("_differs").alias("differs"), F.count_if("_stays").alias("n"))
    dirty = {r["_of"]: r.n for r in homes.filter("differs").collect()}  # two numbers a file
    sizes, _ = planned([dirty.get(i) for i in range(max(1, len(known)))], table.rows_per_file)
    flags = _numbers([int(i in dirty) for i in range(max(1, len(known)))], F.col("_of"))
    placed = numbered(merged.filter(F.col("_stays") & (flags == 1)).drop("_stays", "_differs"), ["_of", key, *(c for c in columns if c != key)])
    ends = spark.sparkContext.broadcast(np.cumsum(sizes, dtype=np.int64))

    @F.arrow_udf("int")
    def file_of(no: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(ends.value, no.to_numpy(zero_copy_only=False), "right"), pa.int32())

    _write(placed, file_of("_no"), len(sizes), table)
    for i in dirty:
        if known:
            fs, name = _path(spark, unquote(known[i].path))
            fs.delete(name, False)
    return {unquote(f.path).rsplit("/", 1)[1] for i, f in enumerate(known) if i not in dirty}


def op11_digests(spark: SparkSession, table: Table, stayed: set[str]) -> DataFrame:
    """A row for each file of the table, read a batch at a time."""
    held = spark.sparkContext.broadcast(stayed)
    folder = table.folder
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    schema = "first_id bigint, n_rows bigint, cents bigint, rows_crc bigint, ids_sha256 string, columns string, path string, rewritten boolean"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for name in map(unquote, batch.column(0).to_pylist()):
                fs, path = filesystem(f"{folder}/{name}")
                first, n, cents, crc, ids = None, 0, 0, 0, hashlib.sha256()
                with fs.open_input_file(path) as raw:
                    file = pq.ParquetFile(raw)
                    names = file.schema_arrow.names
                    for rows in file.iter_batches(1 << 14, columns=["client_id", "source", "segment", "city", "balance"]):
                        keys, source, segment, city, balance = (rows.column(c) for c in ("client_id", "source", "segment", "city", "balance"))
                        keys = keys.to_pylist()
                        first = keys[0] if n == 0 else first
                        ids.update((("," if n else "") + ",".join(map(str, keys))).encode())
                        n += len(keys)
                        money = np.nan_to_num(np.floor(100 * balance.to_numpy(zero_copy_only=False).astype(float) + 0.5), nan=0, posinf=0, neginf=0)
                        cents += int(money.astype(np.int64).sum())
                        crc += sum(zlib.crc32("|".join(x or "" for x in row).encode()) for row in zip(source.to_pylist(), segment.to_pylist(), city.to_pylist(), strict=True))
                row = {"first_id": first, "n_rows": n, "cents": cents, "rows_crc": crc, "ids_sha256": ids.hexdigest(), "columns": ",".join(names), "path": f"{folder}/{name}", "rewritten": name not in held.value}
                yield pa.RecordBatch.from_pylist([row])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "name").mapInArrow(digest, schema)


CHANGES = {"client_id": "bigint", "seq": "bigint", "change_id": "bigint", "op": "string", "source": "string", "segment": "string", "city": "string", "balance": "double"}


def op11_cow_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clients with the changes of client_changes.

    A null client_id is in no start and changes nothing; a null seq or change_id counts as least and deletes by op alone;
    rows that repeat a change are one; a null value is set like any other; a balance that is no number counts as 0
    cents. Texts of any length stand in rows of their own. Without starting files all changes fall to one home without
    a first id: nothing is ignored, and op alone deletes. A table left without rows has no files and gives no rows."""
    clients = first_of_each_name(read(spark, sf_dir, "clients"))
    most = 1 + clients.count() // 700
    text = lambda c: F.col(c).cast("string").cast("binary")
    start = clients.filter(F.crc32(text("client_id")) % 7 > 3)
    folder = f"{shared_dir(spark)}/clients"
    table = create(start, folder, "client_id", most)

    def decide(first: Column) -> Column:
        h = F.coalesce(F.crc32(first.cast("string").cast("binary")) % 12, F.lit(0))
        gone = F.coalesce(F.col("op") == "D", F.lit(False)) | F.coalesce(F.crc32(text("change_id")) % 8 < h, F.lit(False))
        return F.when(h > 7, IGNORE).when(gone, DELETE).otherwise(SET)

    changes = pick(read(spark, sf_dir, "client_changes"), CHANGES)
    stayed = upsert(spark, table, changes, ["seq", "change_id"], ["source", "segment", "city", "balance"], decide)
    if not _exists(spark, folder):
        return spark.createDataFrame([], "first_id bigint, n_rows bigint, cents bigint, rows_crc bigint, ids_sha256 string, columns string, path string, rewritten boolean")
    return op11_digests(spark, table, stayed)
