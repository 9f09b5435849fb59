"""The driver's tables as the domain's relations. Each view has its SQL twin in `SQL`, for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions import text as T

START = "2024-01-01"


BATCH, DEFAULT_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Unless the session has a setting of its own, texts go to Python five hundred at a time."""
    if spark.conf.get(BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH, "500")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, issue_id, issue_date, page_no, headline (the whole first line), body (the rest), text, section, n_chars."""
    d = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    cut = F.instr("text", F.lit("\n"))
    no = F.substr("source", F.lit(4)).cast("int")
    return d.select(
        F.col("doc_id").alias("id"), no.cast("bigint").alias("issue_id"), F.date_add(F.lit(START).cast("date"), no).alias("issue_date"),
        (F.col("doc_id") % 24 + 1).cast("int").alias("page_no"), F.substring_index("text", "\n", 1).alias("headline"),
        F.when(cut > 0, F.substr("text", cut + 1)).otherwise("").alias("body"), "text", F.when(F.col("doc_id") % 7 == 0, "SPORT").alias("section"), F.col("lang").alias("category"), "n_chars",
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with the state that labels give: quality 1 is relevant, no label not judged."""
    a = documents(spark, sf_dir).drop("text").withColumn("content_hash", T.content_hash(F.col("headline"), F.col("body")))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    a = a.join(labels, "id", "left")
    third = F.col("id") % 3
    return a.select(
        "*", (F.col("quality") == 1).alias("relevant"), F.when(third != 0, third == 1).alias("prefilter_passed"),
        F.when(F.col("id") % 5 != 0, (F.col("n_chars") % 100) / 10.0).alias("prefilter_score"),
        F.when(F.col("id") % 11 == 0, "failed").when(F.col("quality").isNull(), "pending").otherwise("done").alias("classify_status"),
        F.when(F.col("id") % 13 != 0, (F.col("n_chars") % 1000) / 1000.0).alias("relevance_score"), F.lit(False).alias("incomplete"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("judiciary"), F.lit("upsc"))).otherwise(F.array(F.lit("general"))).alias("exam_tags"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("issue_id", "issue_date").distinct()
    return d.select(
        F.col("issue_id").alias("id"), "issue_date", F.concat(F.lit("issue"), F.col("issue_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("sha"), F.col("issue_id").cast("string")).alias("pdf_sha256"), F.when(F.col("issue_id") % 4 == 0, "partial").otherwise("done").alias("status"),
        F.when(F.col("issue_id") % 4 == 0, "quota").alias("note"), F.lit(f"{START} 00:00:00").cast("timestamp").alias("created_at"),
    )


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction for each relevant article whose id is no multiple of 4, with the article's vector if it has one."""
    a = articles(spark, sf_dir).filter("relevant and id % 4 <> 0")
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    points = F.array(F.left("body", F.lit(40)), F.concat(F.lit("chars "), F.col("n_chars").cast("string")))
    provisions = F.when(F.col("id") % 3 == 0, F.array(F.struct(F.concat(F.lit("Section "), F.col("page_no").cast("string")).alias("name"), F.lit("section").alias("kind")))).otherwise(F.array().cast("array<struct<name: string, kind: string>>"))
    case = F.when(F.col("id") % 5 == 0, F.struct(F.lit("A v. B").alias("case_name"), F.lit("High Court").alias("court"), F.array(F.lit("X")).alias("bench"), F.lit(None).cast("string").alias("holding")))
    # quotes as models give them: to the letter, with letters lost, with other words put in, or of nothing that is there
    cut, n = F.substr("body", F.lit(10), F.lit(60)), F.col("id") % 8
    quote = F.when(n == 1, F.regexp_replace(cut, "(.{14}).", "$1")).when(n == 3, F.concat(F.left(cut, F.lit(30)), F.lit(" it is said "), F.substr(cut, F.lit(31)))).when(n == 5, F.reverse(cut)).otherwise(cut)
    data = F.struct(
        F.left("body", F.lit(80)).alias("summary"), points.alias("key_points"), case.alias("case"), provisions.alias("provisions"), F.concat(F.lit("on "), F.col("category")).alias("exam_relevance"),
        F.lit(None).cast("date").alias("event_date"), F.array(F.struct(quote.alias("quote"))).alias("evidence"),
    )
    return a.join(v, "id", "left").select(
        F.col("id").alias("article_id"), data.alias("data"),
        F.when(F.col("id") % 5 == 0, "needs_review").when(F.col("id") % 5 == 1, "partial").otherwise("verified").alias("validation_status"),
        F.array().cast("array<string>").alias("warnings"), F.when(F.col("id") % 3 != 2, F.concat(F.lit("v"), (F.col("id") % 3 + 1).cast("string"))).alias("prompt_version"),
        F.concat_ws("\n", "headline", "body").alias("search_text"), "embedding",
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and clicks are votes for, errors against, dealt to all documents in turn."""
    n = read(spark, sf_dir, "documents").agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    e = read(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    vote = F.when(F.col("event_type").isin("purchase", "click"), 1).when(F.col("event_type") == "error", -1)
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") % F.col("_n")).alias("article_id"), vote.alias("vote"), F.col("ts").alias("created_at")).filter("vote is not null")


def _leaf(text: Column) -> Column:
    """A hundredth of the height of a page that has all lines of a text between its header and footer bands."""
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.ceil((lines * 12 + 15) / 94)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines as blocks of one page in three columns of 180 points. Every fifth line is a headline; of each
    twenty the fourth goes on with the first below it, and the fourteenth is a deck of the eleventh."""
    text = F.coalesce("text", F.lit(""))
    # a select of its own: beside the lines, each line would measure its whole text again
    d = read(spark, sf_dir, "documents").select("doc_id", "source", _leaf(text).alias("leaf"), text.alias("text"))
    d = d.select("doc_id", "source", "leaf", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    column, top = F.col("n") % 3, F.col("n") * 12.0 + F.col("leaf") * 3 + 1
    return d.select(
        F.col("source").alias("issue"), F.col("doc_id").cast("int").alias("page"), F.col("n").alias("block_no"), (column * 190.0 + (F.col("n") % 4)).alias("x0"), top.alias("y0"),
        (column * 190.0 + 180).alias("x1"), (top + 13).alias("y1"), F.col("line").alias("text"),
        F.when((F.col("n") % 5 == 0) | (F.col("n") % 20 == 3), 20.25).when(F.col("n") % 20 == 13, 13.0).otherwise(9.0).alias("size"),
        F.lit(False).alias("bold"), F.length("line").alias("nchars"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    height = (_leaf(F.coalesce("text", F.lit(""))) * 100).cast("double")
    return d.select(F.col("source").alias("issue"), F.col("doc_id").cast("int").alias("page"), F.lit(595.0).alias("width"), height.alias("height"))


SQL = {
    "docs": """docs AS (SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS issue_id, CAST(DATE '2024-01-01' + CAST(substr(source, 4) AS INTEGER) AS DATE) AS issue_date,
      CAST(doc_id % 24 + 1 AS INTEGER) AS page_no, split_part(coalesce(text, ''), chr(10), 1) AS headline, coalesce(text, '') AS text,
      CASE WHEN strpos(coalesce(text, ''), chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body,
      CASE WHEN doc_id % 7 = 0 THEN 'SPORT' END AS section, lang AS category, n_chars FROM documents)""",
    "articles": """articles AS (SELECT d.* EXCLUDE (text), sha1(d.headline || '|' || d.body) AS content_hash, quality, toxic, quality = 1 AS relevant,
      CASE WHEN id % 3 <> 0 THEN id % 3 = 1 END AS prefilter_passed, CASE WHEN id % 5 <> 0 THEN (n_chars % 100) / 10.0::DOUBLE END AS prefilter_score,
      CASE WHEN id % 11 = 0 THEN 'failed' WHEN quality IS NULL THEN 'pending' ELSE 'done' END AS classify_status,
      CASE WHEN id % 13 <> 0 THEN (n_chars % 1000) / 1000.0::DOUBLE END AS relevance_score,
      CASE WHEN id % 2 = 0 THEN ['judiciary', 'upsc'] ELSE ['general'] END AS exam_tags
      FROM docs d LEFT JOIN labels l ON l.doc_id = d.id)""",
    "issues": """issues AS (SELECT DISTINCT issue_id AS id, issue_date, 'issue' || issue_id || '.pdf' AS filename, 'sha' || issue_id AS pdf_sha256,
      CASE WHEN issue_id % 4 = 0 THEN 'partial' ELSE 'done' END AS status, CASE WHEN issue_id % 4 = 0 THEN 'quota' END AS note FROM docs)""",
    "extractions": """extractions AS (SELECT a.id AS article_id, left(body, 80) AS summary, [left(body, 40), 'chars ' || n_chars] AS key_points,
      CASE WHEN a.id % 3 = 0 THEN 'Section ' || page_no END AS provision, CASE WHEN a.id % 5 = 0 THEN 'A v. B' END AS case_name, CASE WHEN a.id % 5 = 0 THEN 'High Court' END AS court,
      'on ' || category AS exam_relevance, CASE WHEN a.id % 5 = 0 THEN 'needs_review' WHEN a.id % 5 = 1 THEN 'partial' ELSE 'verified' END AS validation_status,
      CASE WHEN a.id % 3 <> 2 THEN 'v' || (a.id % 3 + 1) END AS prompt_version, headline || chr(10) || body AS search_text, embedding
      FROM articles a LEFT JOIN embeddings v ON v.vec_id = a.id WHERE relevant AND a.id % 4 <> 0)""",
    "feedback": """feedback AS (SELECT event_id AS id, event_id % (SELECT greatest(count(*), 1) FROM documents) AS article_id, CASE WHEN event_type IN ('purchase', 'click') THEN 1 WHEN event_type = 'error' THEN -1 END AS vote,
      ts AS created_at FROM events WHERE event_type IN ('purchase', 'click', 'error'))""",
    "cards": """cards AS (SELECT a.id, a.page_no, a.headline, a.body, a.category, a.exam_tags, a.relevance_score, a.issue_date, e.* EXCLUDE (article_id)
      FROM articles a JOIN issues i ON i.id = a.issue_id JOIN extractions e ON e.article_id = a.id)""",
    "brief": """brief AS (SELECT *, row_number() OVER (PARTITION BY issue_date ORDER BY relevance_score DESC NULLS LAST, page_no NULLS LAST, id) AS seq FROM cards)""",
    "blocks": """blocks AS (SELECT issue, page, n AS block_no, (n % 3) * 190.0 + (n % 4) AS x0, n * 12.0 + leaf * 3 + 1 AS y0, (n % 3) * 190.0 + 180 AS x1, n * 12.0 + leaf * 3 + 14 AS y1, line AS text, leaf * 100 AS height,
      CASE WHEN n % 5 = 0 OR n % 20 = 3 THEN 20.25 WHEN n % 20 = 13 THEN 13.0 ELSE 9.0 END::DOUBLE AS size, length(line) AS nchars
      FROM (SELECT source AS issue, CAST(doc_id AS INTEGER) AS page, unnest(ls) AS line, unnest(range(len(ls))) AS n, ceil((len(ls) * 12 + 15) / 94) AS leaf FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))""",
}
NEEDS = {"articles": ["docs"], "issues": ["docs"], "extractions": ["articles"], "cards": ["articles", "issues", "extractions"], "brief": ["cards"]}


def with_views(names: list[str], body: str) -> str:
    """`body` after the common table expressions it names, in order of need."""
    seen: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        if name not in seen:
            seen.append(name)

    for n in names:
        need(n)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in seen) + "\n" + body
