"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.schemas import BLOCKS, PAGES, SPANS


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, filename, sha256 and content of each file."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), "content")


def decoded(files: DataFrame, decode: Callable[[bytes], list[dict]]) -> DataFrame:
    """Spans of documents by a given decoder (no PDF library is assumed); its rows lack only `issue`, which is the
    file's name. Text blocks only: a decoder skips images."""
    names = [c.split()[0] for c in SPANS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for name, content in zip(rows["filename"], rows["content"], strict=True):
                yield pd.DataFrame([s | {"issue": name} for s in decode(content)], columns=names)

    return files.select("filename", "content").mapInPandas(run, SPANS)


def measured(files: DataFrame, measure: Callable[[bytes], list[dict]]) -> DataFrame:
    """page, width and height of each document's pages, also of those without text, by a given function."""
    names = [c.split()[0] for c in PAGES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for name, content in zip(rows["filename"], rows["content"], strict=True):
                yield pd.DataFrame([p | {"issue": name} for p in measure(content)], columns=names)

    return files.select("filename", "content").mapInPandas(run, PAGES)


def spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPANS).parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def page_texts(blocks: DataFrame, last: int = 2) -> DataFrame:
    """issue, page, text of the first pages, blocks in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda s: s["text"]), "\n")
    return blocks.filter(F.col("page") <= last).groupBy("issue", "page").agg(text.alias("text"))


def gold_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Labelled CSV files, or folders of them, with their number in the list and the row's place: files of a folder by
    name, then the row in its file (a file is read by one task, so its rows' numbers rise)."""
    schema = "content_hash string, page_no string, headline string, snippet string, human string"
    out = None
    for n, path in enumerate(paths):
        rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        rows = rows.select("content_hash", "human", F.lit(n).alias("file_no"), F.struct(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n")).alias("row_no"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_labels(export: DataFrame, path: str) -> None:
    """One folder of CSV files for each issue date, rows by page."""
    (export.repartition("issue_date").sortWithinPartitions("issue_date", "page_no", "content_hash")
     .write.partitionBy("issue_date").option("header", True).option("escape", '"').csv(path))


def last_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
