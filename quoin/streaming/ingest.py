"""Incremental ingest: new files of a folder, each handed to a batch function once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quoin.operators import store
from quoin.plans import ingest
from quoin.settings import Settings


def ingest_new_files(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Processes what has arrived and stops. The checkpoint remembers what was handled; `handle` gets a batch and
    its number, which is the same when a batch is repeated after a failure."""
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return new.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


UPLOADS = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_uploads(
    db: store.Store, folder: str, spans: Callable[[bytes], list[dict]], measure: Callable[[bytes], list[dict]], models: ingest.Models, settings: Settings, checkpoint: str,
    files_per_batch: int = 20, glob: str = "*", once: bool = True,
) -> StreamingQuery:
    """Documents that are uploaded to a folder go through `plans.ingest.process`, a few at a time; with `once` the
    query ends when all that is there is done. A batch that is repeated after a failure finds its issues known, its
    articles stored and its calls answered, and changes nothing that was done."""

    def handle(batch: DataFrame, _: int) -> None:
        raw = batch.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), "content")
        files, pages, blocks = ingest.decoded(db, ingest.written(db, raw), spans, measure)
        ingest.process(db, files, pages, blocks, models, settings)

    new = db.spark.readStream.format("binaryFile").schema(UPLOADS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).load(folder)
    writer = new.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
