"""State as snapshots: each change takes tables and returns the new ones, in one set-based pass.

Ids are kept where a key exists and continue from the largest elsewhere. `Store` writes what changed to a folder of
its own and then one log entry, so a reader never sees half a change and nothing that is read is overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin import schemas
from quoin.operators import fulltext

CARD = ("id", "page_no", "headline", "body", "category", "exam_tags", "relevance_score", "incomplete")
PARTS = {"articles": "issue_id"}  # tables of which a change writes the touched parts alone


class Conflict(RuntimeError):
    """Another writer's change came first; nothing was changed."""


class Store:
    """Tables below a folder that all executors see. A change is a file of the log, numbered without gaps, that says
    where parts of tables now lie; it is created only if no other writer has created that number since this store
    last read the log."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.seen, self.paths = 0, {}  # (table, part) to path; part "" is the whole table

    def init(self) -> None:
        self.commit({n: self.spark.createDataFrame([], s) for n, s in schemas.TABLES.items()})

    def _file(self, number: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log/{number:012d}.json")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def refresh(self) -> None:
        """Reads the log's new entries."""
        while True:
            system, path = self._file(self.seen + 1)
            if not system.exists(path):
                return
            stream = system.open(path)
            try:
                entry = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            self.paths |= {(name, part): to for name, part, to in entry}
            self.seen += 1

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """The table, or its parts with the given keys."""
        self.refresh()
        wanted = None if only is None else {str(k) for k in only}
        paths = [to for (n, part), to in self.paths.items() if n == name and to and (wanted is None or part in wanted)]
        return self.spark.read.schema(schemas.TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], schemas.TABLES[name])

    def commit(self, tables: dict[str, DataFrame], only: list[int] | None = None) -> None:
        """All tables of a change become visible at once. Of tables in parts, `only` names the keys that are
        replaced by the given rows, all of which have such keys; without it all parts are."""
        self.refresh()
        entry: list[tuple[str, str, str]] = []
        for name, df in tables.items():
            to = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            if name in PARTS:
                df.withColumn("part_key", F.col(PARTS[name])).repartition("part_key").write.partitionBy("part_key").parquet(to)
                written = {str(r.part_key) for r in self.spark.read.schema(f"{schemas.TABLES[name]}, part_key bigint").parquet(to).select("part_key").distinct().collect()}
                old = {part for n, part in self.paths if n == name} if only is None else {str(k) for k in only}
                entry += [(name, part, f"{to}/part_key={part}" if part in written else "") for part in sorted(old | written)]
            else:
                df.write.parquet(to)
                entry.append((name, "", to))
        system, path = self._file(self.seen + 1)
        if system.exists(path):
            raise Conflict(f"{self.folder}: change {self.seen + 1} is another writer's")
        stream = system.create(path, False)  # fails if it exists by now
        try:
            stream.write(json.dumps(entry).encode())
        finally:
            stream.close()
        self.refresh()


def numbered(new: DataFrame, existing: DataFrame, block: Column, order: list) -> DataFrame:
    """`id` continues from the largest existing one, by block and then by `order`. Blocks are counted first, so rows
    are sorted a block at a time."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    blocks = new.withColumn("_block", block)
    before = Window.orderBy(F.asc_nulls_first("_block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("_block").agg(F.count("*").alias("_n")).select(F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = starts.crossJoin(F.broadcast(top))  # one row
    number = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    joined = blocks.withColumn("_number", number).join(starts, F.col("_block").eqNullSafe(F.col("_b")))
    return joined.withColumn("id", (F.col("_top") + F.col("_start") + F.col("_number")).cast("bigint")).drop("_block", "_b", "_start", "_top", "_number")


def one_a_date(files: DataFrame) -> DataFrame:
    """Of several files of a date the one whose name, then hash, comes last. A file without date is an error."""
    named = F.concat(F.lit("no issue date for "), F.coalesce("filename", F.lit("a file without name")))
    dated = F.when(F.col("issue_date").isNull(), F.raise_error(named).cast("date")).otherwise(F.col("issue_date"))
    last = Window.partitionBy("issue_date").orderBy(F.desc_nulls_last("filename"), F.desc_nulls_last("pdf_sha256"))
    return files.withColumn("issue_date", dated).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def upsert_issues(issues: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """incoming: issue_date, filename, pdf_sha256, created_at, of which `one_a_date` counts. Returns the new issues and
    the ids whose articles must go because the file changed. Known dates keep id and created_at; status and note
    start over."""
    new = one_a_date(incoming).select(F.col("issue_date").alias("_d"), F.col("filename").alias("_f"), F.col("pdf_sha256").alias("_s"), F.col("created_at").alias("_c"))
    joined = issues.join(new, F.col("issue_date") == F.col("_d"), "full_outer")
    seen, fresh = F.col("id").isNotNull(), F.col("_d").isNotNull()
    changed = joined.filter(seen & fresh & ~F.col("pdf_sha256").eqNullSafe(F.col("_s"))).select("id")
    old = joined.filter(seen).select(
        "id", "issue_date", F.when(fresh, F.col("_f")).otherwise(F.col("filename")).alias("filename"), F.when(fresh, F.col("_s")).otherwise(F.col("pdf_sha256")).alias("pdf_sha256"),
        F.when(fresh, "processing").otherwise(F.col("status")).alias("status"), F.when(~fresh, F.col("note")).alias("note"), "created_at",
    )
    added = joined.filter(~seen).select(F.col("_d").alias("issue_date"), F.col("_f").alias("filename"), F.col("_s").alias("pdf_sha256"), F.lit("processing").alias("status"), F.lit(None).cast("string").alias("note"), F.col("_c").alias("created_at"))
    return old.unionByName(numbered(added, issues, F.year("issue_date"), ["issue_date"])), changed


def first_of_each(incoming: DataFrame, order: list) -> DataFrame:
    by = Window.partitionBy("issue_id", "content_hash").orderBy(*order)
    return incoming.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def insert_articles(articles: DataFrame, incoming: DataFrame, order: list, every: DataFrame | None = None) -> DataFrame:
    """Unique by (issue_id, content_hash): the first wins, against what exists and among themselves. Ids rise with
    `order` within an issue, after the largest of `every`, where `articles` are only some of them."""
    new = first_of_each(incoming, order).join(articles.select("issue_id", "content_hash"), ["issue_id", "content_hash"], "left_anti")
    new = numbered(new, articles if every is None else every, F.col("issue_id"), order).withColumn("classify_status", F.lit("pending")).withColumn("exam_tags", F.array().cast("array<string>"))
    return articles.unionByName(new, allowMissingColumns=True)


def pending_prefilter(articles: DataFrame) -> DataFrame:
    return articles.filter("prefilter_passed is null")


def set_prefilter(articles: DataFrame, results: DataFrame) -> DataFrame:
    """results: id, passed, score. Passing articles wait for classification, others are skipped."""
    r = results.select(F.col("id").alias("_id"), "passed", "score")
    joined = articles.join(r, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    new = {
        "prefilter_passed": F.col("passed"), "prefilter_score": F.col("score").cast("float"), "classify_status": F.when(F.col("passed"), "pending").otherwise("skipped"),
    }
    return joined.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in articles.columns))


def pending_classify(articles: DataFrame) -> DataFrame:
    """In the order of work: by issue, best prefilter score first. Failed ones are tried again."""
    due = articles.filter(F.col("prefilter_passed") & F.col("classify_status").isin("pending", "failed"))
    return due.withColumn("seq", F.row_number().over(Window.partitionBy("issue_id").orderBy(F.desc_nulls_last("prefilter_score"), "id")))


def set_classification(articles: DataFrame, results: DataFrame) -> DataFrame:
    """results: id, status (done or failed), relevant, category, exam_tags, score, reason. Failure leaves earlier
    answers as they are."""
    r = results.select(*(F.col(c).alias(f"_{c}") for c in ("id", "status", "relevant", "category", "exam_tags", "score", "reason")))
    joined = articles.join(r, F.col("id") == F.col("_id"), "left")
    done = F.col("_status") == "done"
    new = {"relevant": F.col("_relevant"), "category": F.col("_category"), "exam_tags": F.col("_exam_tags"), "relevance_score": F.col("_score").cast("float"), "reason": F.col("_reason")}
    status = F.coalesce("_status", "classify_status").alias("classify_status")
    return joined.select(*(F.when(done, new[c]).otherwise(F.col(c)).alias(c) if c in new else status if c == "classify_status" else F.col(c) for c in articles.columns))


def pending_extract(articles: DataFrame, extractions: DataFrame, version: str) -> DataFrame:
    """Relevant articles without an extraction or with one of another version. A null version is not another."""
    e = extractions.select(F.col("article_id").alias("_a"), F.col("prompt_version").alias("_v"))
    due = articles.filter("relevant").join(e, F.col("id") == F.col("_a"), "left").filter(F.col("_a").isNull() | (F.col("_v") != version))
    return due.drop("_a", "_v").withColumn("seq", F.row_number().over(Window.partitionBy("issue_id").orderBy(F.desc_nulls_last("relevance_score"), "id")))


def upsert_extractions(extractions: DataFrame, incoming: DataFrame) -> DataFrame:
    """A replaced row loses its embedding and keeps created_at. Where vectors are kept, they follow the search text."""
    kept = extractions.select("article_id", F.col("created_at").alias("_old"))
    new = incoming.join(kept, "article_id", "left").withColumn("created_at", F.coalesce("_old", "created_at")).drop("_old", "embedding")
    new = new.withColumn("embedding", F.lit(None).cast("array<float>"))
    if "tsv" in extractions.columns:
        new = fulltext.with_vectors(new)
    return extractions.join(incoming.select("article_id"), "article_id", "left_anti").unionByName(new)


def needing_embedding(articles: DataFrame, extractions: DataFrame) -> DataFrame:
    due = extractions.filter("embedding is null").select("article_id", "search_text")
    return due.join(articles.select(F.col("id").alias("article_id"), "issue_id"), "article_id")


def set_embeddings(extractions: DataFrame, vectors: DataFrame) -> DataFrame:
    """vectors: article_id, embedding; stored with six decimals."""
    v = vectors.select(F.col("article_id").alias("_a"), F.transform("embedding", lambda x: F.round(x.cast("double"), 6).cast("float")).alias("_e"))
    joined = extractions.join(v, F.col("article_id") == F.col("_a"), "left")
    return joined.select(*(F.coalesce("_e", "embedding").alias(c) if c == "embedding" else F.col(c) for c in extractions.columns))


def finish_issues(issues: DataFrame, ended: DataFrame) -> DataFrame:
    """ended: id, status, note. An empty note is stored as null; other issues stay as they are."""
    new = ended.select(F.col("id").alias("_id"), F.col("status").alias("_s"), F.nullif("note", F.lit("")).alias("_n"))
    joined, mine = issues.join(new, F.col("id") == F.col("_id"), "left"), F.col("_id").isNotNull()
    values = {"status": F.col("_s"), "note": F.col("_n")}
    return joined.select(*(F.when(mine, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in issues.columns))


def prune_victims(issues: DataFrame, keep: int, protect: int | None = None) -> DataFrame:
    """Issues that are not among the newest `keep` dates and not protected."""
    newest = issues.orderBy(F.desc("issue_date")).limit(keep).select("id")
    return issues.join(newest, "id", "left_anti").filter(~F.col("id").eqNullSafe(F.lit(protect).cast("bigint"))).select("id", "issue_date")


def delete_issues(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The issues with these ids go, with their articles, extractions and votes."""
    out = delete_articles(tables, tables["articles"].join(ids.select(F.col("id").alias("issue_id")), "issue_id", "left_semi").select("id"))
    return out | {"issues": tables["issues"].join(ids.select("id"), "id", "left_anti")}


def delete_articles(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    gone = ids.select(F.col("id").alias("article_id"))
    return tables | {
        "articles": tables["articles"].join(ids.select("id"), "id", "left_anti"),
        "extractions": tables["extractions"].join(gone, "article_id", "left_anti"),
        "feedback": tables["feedback"].join(gone, "article_id", "left_anti"),
    }


def delete_date(tables: dict[str, DataFrame], date: Column) -> dict[str, DataFrame]:
    return delete_issues(tables, tables["issues"].filter(F.col("issue_date") == date).select("id"))


def save_feedback(feedback: DataFrame, votes: DataFrame) -> DataFrame:
    """votes: article_id, vote, note, created_at. Votes other than 1 and -1 are an error."""
    right = F.when(F.col("vote").isin(-1, 1), F.col("vote")).otherwise(F.raise_error(F.lit("vote must be 1 or -1")).cast("int"))
    return feedback.unionByName(numbered(votes.withColumn("vote", right), feedback, F.date_trunc("hour", "created_at"), ["created_at", "article_id"]).select(*feedback.columns))
