"""The ingest of issues: layout, storing, prefilter, classification, extraction, embedding, retention.

Every stage commits its result before the next reads it, so a run that stops is continued by running again, and no
outside call is repeated for what is already stored. Of the articles, which hold the texts, a stage reads and writes
the parts of this run's issues alone.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.operators import enrich, grounding, layout, prefilter, reports, store
from quoin.operators.calls import QUOTA, Message, Providers
from quoin.settings import Settings
from quoin.sources import files as sources
from quoin.sources.files import page_texts
from quoin.sources.ledger import Ledger

Embed = Callable[[list[str]], list[list[float]] | None]


@dataclass(frozen=True)
class Models:
    """What is known by name: providers of texts, and functions that embed. Settings choose among them."""

    providers: dict[str, Callable[[list[Message]], str]]
    embedders: dict[str, Embed] = field(default_factory=dict)
    classify_system: str = enrich.CLASSIFY_SYSTEM
    extract_system: str = enrich.EXTRACT_SYSTEM

    def chain(self, names: str, s: Settings) -> Providers:
        return Providers.named(names, self.providers, s.min_interval_sec)

    def embedder(self, s: Settings) -> Embed | None:
        """None where embeddings are off or there is no such function: search by words still works."""
        if not s.embeddings_enabled or not self.embedders:
            return None
        return self.embedders.get(s.embed_model) if s.embed_model else next(iter(self.embedders.values()))


def detect_dates(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """files: issue, filename, pdf_sha256. Adds issue_date."""
    pages = page_texts(blocks).groupBy("issue").agg(*(F.max(F.when(F.col("page") == n, F.col("text"))).alias(f"p{n}") for n in (1, 2)))
    joined = files.join(pages, "issue", "left")
    return joined.withColumn("issue_date", T.issue_date(F.col("p1"), F.col("p2"), F.col("filename"))).drop("p1", "p2")


def segmented(found: DataFrame, p: layout.Layout = layout.Layout()) -> DataFrame:
    """found: what `layout.articles` gives, written, since stitching reads it several times. Articles with
    content_hash, long enough."""
    done = layout.long_enough(layout.stitch(found, p), p)
    return done.withColumn("content_hash", T.content_hash(F.col("headline"), F.col("body")))


def scan_note(scanned: Column, shown: int = 10) -> Column:
    """Of the numbers of an issue's pages without text; null where there are none."""
    numbers = F.array_join(F.slice(scanned, 1, shown).cast("array<string>"), ", ")
    return F.when(F.size(scanned) > 0, F.concat(F.size(scanned).cast("string"), F.lit(" page(s) without text, which would need OCR: "), numbers))


QUOTA_NOTE = "The providers' quota is used up: process the same file again to go on from here."


def process(db: store.Store, files: DataFrame, pages: DataFrame, blocks: DataFrame, models: Models, s: Settings = Settings(), rules: prefilter.Rules = prefilter.Rules(), progress: Callable[[str, int, int], None] = lambda *_: None) -> DataFrame:
    """files: issue, filename, pdf_sha256 and, if known, issue_date. Returns the statistics of the issues. A file whose
    date is neither given nor found is an error, before anything is stored; of several files of a date one counts, as
    `store.one_a_date` has it. `progress` gets a stage, how many of its rows are done, and how many there are."""
    if "issue_date" not in files.columns:
        files = detect_dates(files, blocks)
    files = written(db, files)
    undated = [r.filename for r in files.filter("issue_date is null").select("filename").limit(20).collect()]
    if undated:
        raise ValueError(f"no issue date for {', '.join(map(str, undated))}: give issue_date")
    files = store.one_a_date(files)
    now = F.current_timestamp()
    issues, changed = store.upsert_issues(db.table("issues"), files.select("issue_date", "filename", "pdf_sha256", now.alias("created_at")))
    replaced = [r.id for r in changed.collect()]  # one for each file at most
    old = {n: db.table(n) for n in ("extractions", "feedback")} | {"articles": db.table("articles", replaced)}
    db.commit({"issues": issues} | (store.delete_articles(old, old["articles"].select("id")) if replaced else {}), replaced)

    dated = written(db, files.select("issue", "issue_date").join(db.table("issues").select(F.col("id").alias("issue_id"), "issue_date"), "issue_date"))
    ids = [r.issue_id for r in dated.select("issue_id").collect()]  # one for each file
    mine = dated.select("issue_id")

    def articles() -> DataFrame:
        return db.table("articles", ids)

    raw = segmented(written(db, layout.articles(pages, blocks))).join(dated, "issue").withColumnRenamed("page", "page_no")
    incoming = raw.select("issue_id", "page_no", "section", "headline", "body", "content_hash", "incomplete", "head")
    db.commit({"articles": store.insert_articles(articles(), incoming, ["page_no", "head"], db.table("articles")).drop("head")}, ids)
    progress("segmented", len(ids), len(ids))

    scored = written(db, prefilter.prefilter(store.pending_prefilter(articles()), replace(rules, min_score=max(rules.min_score, s.prefilter_min_score))).select("id", "passed", "score"))
    db.commit({"articles": store.set_prefilter(articles(), scored)}, ids)
    _report(progress, "prefilter", scored, None)

    status, ledger = "done", Ledger(f"{db.folder}/answers/{quote(s.prompt_version, safe='')}")  # a run that is killed repeats no call
    due = store.pending_classify(articles())
    answers = written(db, enrich.classify(due, models.chain(s.classify_chain or s.provider_chain, s), models.classify_system, s.classify_batch_size, s.relevance_cut, ledger=ledger))
    db.commit({"articles": store.set_classification(articles(), answers.filter(F.col("status") != QUOTA))}, ids)
    status = _report(progress, "classify", answers, "status")

    if status == "done":
        due = store.pending_extract(articles(), db.table("extractions"), s.prompt_version).join(dated.select("issue_id", "issue_date"), "issue_id")
        notes = written(db, enrich.extract(due, models.chain(s.provider_chain, s), models.extract_system, s.max_notes_per_run, ledger=ledger))
        bodies = articles().select(F.col("id").alias("article_id"), "headline", "body")
        checked = grounding.validate(notes.filter("status = 'done'").drop("status").join(bodies, "article_id"))
        rows = checked.select(
            "article_id", "data", F.col("status").alias("validation_status"), "warnings", "model", F.lit(s.prompt_version).alias("prompt_version"),
            grounding.search_text(F.col("headline"), F.col("data")).alias("search_text"), now.alias("created_at"),
        )
        db.commit({"extractions": store.upsert_extractions(db.table("extractions"), written(db, rows))})
        status = _report(progress, "extract", notes, "status")

    if status == "done" and (embedder := models.embedder(s)):
        need = written(db, store.needing_embedding(articles(), db.table("extractions")))
        vectors = written(db, enrich.embed(need, embedder, s.embed_dim, s.embed_batch_size))
        db.commit({"extractions": store.set_embeddings(db.table("extractions"), vectors)})
        progress("embed", vectors.count(), need.count())

    scanned = layout.scanned_pages(pages, blocks).groupBy("issue").agg(F.array_sort(F.collect_list("page")).alias("scanned")).join(dated, "issue")
    notes = scanned.select(F.col("issue_id").alias("id"), scan_note(F.col("scanned")).alias("scan"))
    ended = mine.select(F.col("issue_id").alias("id")).join(notes, "id", "left")
    ended = ended.select("id", F.lit(status).alias("status"), F.concat_ws("; ", "scan", F.lit(None if status == "done" else QUOTA_NOTE).cast("string")).alias("note"))
    finished = written(db, store.finish_issues(db.table("issues"), ended))
    victims = written(db, store.prune_victims(finished, s.keep_issues).join(mine.withColumnRenamed("issue_id", "id"), "id", "left_anti"))
    out = [r.id for r in victims.select("id").collect()]  # issues that retention lets go
    tables = {n: db.table(n) for n in ("extractions", "feedback")} | {"issues": finished, "articles": db.table("articles", out)}
    db.commit(store.delete_issues(tables, victims), out)
    stats = reports.issue_stats(db.table("issues"), db.table("articles"), db.table("extractions"))
    return stats.join(mine, "issue_id", "left_semi")


def _report(progress: Callable[[str, int, int], None], stage: str, rows: DataFrame, status: str | None) -> str:
    """Reports a stage's written rows; partial if the quota kept any from being done."""
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col(status) == "done" if status else F.lit(True)).alias("done"), F.count_if(F.col(status) == QUOTA if status else F.lit(False)).alias("quota")).first()
    progress(stage, n.done, n.n)
    return "partial" if n.quota else "done"


def written(db: store.Store, rows: DataFrame) -> DataFrame:
    """A stage's answers, written once: later reads never call a model again."""
    path = f"{db.folder}/stages/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return db.spark.read.schema(rows.schema).parquet(path)


def decoded(db: store.Store, raw: DataFrame, spans: Callable[[bytes], list[dict]], measure: Callable[[bytes], list[dict]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, pages and blocks of documents (filename, sha256, content), each decoded once."""
    files = raw.select(F.col("filename").alias("issue"), "filename", F.col("sha256").alias("pdf_sha256"))
    return files, written(db, sources.measured(raw, measure)), written(db, layout.blocks(written(db, sources.decoded(raw, spans))))
