"""The library's own queries over the driver's tables, with their SQL equivalents where SQL can express them."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin import schemas, twins, views
from quoin.functions import stems, text as T
from quoin.functions.similarity import partial_ratio_udf, token_set_ratio_udf
from quoin.sources.shared import new_folder
from quoin.operators import calls, dedup, enrich, evaluate, fulltext, grounding, layout, prefilter, reports, search, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CARD = ("issue_date", "seq", "id", "page_no", "headline", "category", "relevance_score", "validation_status")
RULES = prefilter.Rules(
    strong=(r"licen[sc]e", r"version\s+\d+", "idiot", "public"), weak=("moron", "contact", "email", r"ation(?:al|s)", "mente|keit", "https?", "thth"), junk=r"\b(spam|lorem)\b"
)
QUERY = "tion of the licensed version"
VECTOR = [((i * 37) % 64 - 31.5) / 150 for i in range(64)]


def query(name: str, needs: list[str] | None = None, sql: str | None = None):
    """Registers a query; `sql` follows the common table expressions of the views it needs."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = views.with_views(needs, sql) if needs else sql
        return f

    return register


def _tables(spark, d):
    return {"articles": views.articles(spark, d), "issues": views.issues(spark, d), "extractions": views.extractions(spark, d), "feedback": views.feedback(spark, d)}


def _cards(spark, d):
    t = _tables(spark, d)
    return search.cards(t["articles"], t["issues"], t["extractions"])


def _brief(spark, d):
    return reports.brief(_cards(spark, d))


# ---- reports ----
_CARD_SQL = "SELECT " + ", ".join(CARD).replace("seq", "CAST(seq AS INTEGER) AS seq") + " FROM "


@query("brief", ["brief"], _CARD_SQL + "brief")
def brief(spark, d):
    return _brief(spark, d).select(*CARD)


@query(
    "issue_stats", ["issues", "extractions"],
    """SELECT i.id AS issue_id, i.issue_date, i.status, i.note, count(a.id) AS articles, count(*) FILTER (WHERE a.prefilter_passed) AS passed_prefilter,
    count(*) FILTER (WHERE a.relevant) AS relevant, count(e.article_id) AS extracted
    FROM issues i LEFT JOIN articles a ON a.issue_id = i.id LEFT JOIN extractions e ON e.article_id = a.id GROUP BY ALL""",
)
def issue_stats(spark, d):
    t = _tables(spark, d)
    return reports.issue_stats(t["issues"], t["articles"], t["extractions"])


@query("issue_dates", ["issues"], "SELECT issue_date FROM issues")
def issue_dates(spark, d):
    return reports.issue_dates(views.issues(spark, d))


@query(
    "feedback_summary", ["articles", "issues", "feedback"],
    """SELECT a.id AS article_id, a.headline, a.page_no, i.issue_date, CAST(sum(CASE WHEN vote = 1 THEN 1 ELSE 0 END) AS BIGINT) AS up,
    CAST(sum(CASE WHEN vote = -1 THEN 1 ELSE 0 END) AS BIGINT) AS down, max(created_at) AS last
    FROM feedback f JOIN articles a ON a.id = f.article_id JOIN issues i ON i.id = a.issue_id
    GROUP BY ALL ORDER BY down DESC, last DESC, article_id LIMIT 100""",
)
def feedback_summary(spark, d):
    return reports.feedback_summary(views.feedback(spark, d), views.articles(spark, d), views.issues(spark, d))


@query("cards_filtered", ["cards"], """SELECT id, issue_date, category, relevance_score FROM cards
    WHERE issue_date >= DATE '2024-01-03' AND issue_date <= DATE '2024-01-15' AND category = 'en' AND list_contains(exam_tags, 'upsc')""")  # fmt: skip
def cards_filtered(spark, d):
    where = search.filters(datetime.date(2024, 1, 3), datetime.date(2024, 1, 15), "en", "upsc")
    return _cards(spark, d).filter(where).select("id", "issue_date", "category", "relevance_score")


@query("hidden_unverified", ["brief"], "SELECT issue_date, count(*) FILTER (WHERE validation_status = 'needs_review') AS hidden FROM brief WHERE category IN ('en', 'fr') GROUP BY ALL")
def hidden_unverified(spark, d):
    return reports.hidden_count(_brief(spark, d).filter(reports.ui_filter(["en", "fr"])))


@query("verified_cards", ["brief"], "SELECT id FROM brief WHERE category IN ('en', 'de') AND list_contains(exam_tags, 'general') AND validation_status <> 'needs_review'")
def verified_cards(spark, d):
    return reports.verified(_cards(spark, d).filter(reports.ui_filter(["en", "de"], "general"))).select("id")


@query("top_picks", ["brief"], _CARD_SQL + "brief WHERE seq <= 5")
def top_picks(spark, d):
    return reports.top_picks(_brief(spark, d)).select(*CARD)


@query("category_rest", ["brief"], """SELECT issue_date, CAST(seq AS INTEGER) AS seq, id, category, CAST(list_position(['fr', 'en', 'de'], category) AS INTEGER) AS category_no
    FROM brief WHERE seq > 5 AND category IN ('fr', 'en', 'de')""")  # fmt: skip
def category_rest(spark, d):
    return reports.remainder(_brief(spark, d), ["fr", "en", "de"]).select("issue_date", "seq", "id", "category", "category_no")


@query("category_counts", ["brief"], "SELECT issue_date, category, count(*) AS notes FROM brief WHERE seq > 5 GROUP BY ALL")
def category_counts(spark, d):
    return reports.category_counts(_brief(spark, d))


_LABELS = {"en": "English", "fr": "French"}
_NOTE_SQL = """'## ' || headline || '  (p.' || page_no || ' | ' || CASE category WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE category END || ')' || chr(10) || summary || chr(10)
    || chr(10) || '- ' || key_points[1] || chr(10) || '- ' || key_points[2] || CASE WHEN provision IS NOT NULL THEN chr(10) || '**Provisions:** ' || provision ELSE '' END
    || chr(10) || chr(10) || '_Exam angle (AI note): ' || exam_relevance || '_' || chr(10)"""


@query("markdown_export", ["brief"], f"""SELECT issue_date, '# Brief - ' || strftime(issue_date, '%d %b %Y') || chr(10) || chr(10) || string_agg({_NOTE_SQL}, chr(10) ORDER BY seq) AS markdown
    FROM brief GROUP BY issue_date""")  # fmt: skip
def markdown_export(spark, d):
    return reports.markdown(_brief(spark, d), "Brief", _LABELS)


@query("chips", ["cards"], "SELECT id, '`' || category || '` `' || validation_status || '` ' || array_to_string(list_transform(exam_tags, lambda t: '`' || t || '`'), ' ') AS chips FROM cards")
def chips(spark, d):
    return _cards(spark, d).select("id", reports.chips().alias("chips"))


# ---- state ----
@query("pending_prefilter", ["articles"], "SELECT id, issue_id, section FROM articles WHERE prefilter_passed IS NULL")
def pending_prefilter(spark, d):
    return store.pending_prefilter(views.articles(spark, d)).select("id", "issue_id", "section")


_WORK = "row_number() OVER (PARTITION BY issue_id ORDER BY prefilter_score DESC NULLS LAST, id)"


@query("pending_classify", ["articles"], f"SELECT id, issue_id, CAST({_WORK} AS INTEGER) AS seq FROM articles WHERE prefilter_passed AND classify_status IN ('pending', 'failed')")
def pending_classify(spark, d):
    return store.pending_classify(views.articles(spark, d)).select("id", "issue_id", "seq")


@query("classify_batches", ["articles"], f"""SELECT issue_id, CAST(floor((seq - 1) / 8) AS BIGINT) AS batch, count(*) AS n, min(id) AS first_id
    FROM (SELECT *, {_WORK} AS seq FROM articles WHERE prefilter_passed AND classify_status IN ('pending', 'failed')) GROUP BY ALL""")  # fmt: skip
def classify_batches(spark, d):
    due = store.pending_classify(views.articles(spark, d)).withColumn("batch", F.floor((F.col("seq") - 1) / 8))
    return due.groupBy("issue_id", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("pending_extract", ["extractions"], """SELECT a.id, a.issue_id, CAST(row_number() OVER (PARTITION BY a.issue_id ORDER BY relevance_score DESC NULLS LAST, a.id) AS INTEGER) AS seq
    FROM articles a LEFT JOIN extractions e ON e.article_id = a.id WHERE a.relevant AND (e.article_id IS NULL OR e.prompt_version <> 'v2')""")  # fmt: skip
def pending_extract(spark, d):
    return store.pending_extract(views.articles(spark, d), views.extractions(spark, d), "v2").select("id", "issue_id", "seq")


@query("extract_cap", ["extractions"], """SELECT id FROM (SELECT a.id, row_number() OVER (PARTITION BY a.issue_id ORDER BY relevance_score DESC NULLS LAST, a.id) AS seq
    FROM articles a LEFT JOIN extractions e ON e.article_id = a.id WHERE a.relevant AND (e.article_id IS NULL OR e.prompt_version <> 'v2')) WHERE seq <= 3""")  # fmt: skip
def extract_cap(spark, d):
    return store.pending_extract(views.articles(spark, d), views.extractions(spark, d), "v2").filter("seq <= 3").select("id")


@query("needing_embedding", ["extractions"], "SELECT e.article_id, a.issue_id, e.search_text FROM extractions e JOIN articles a ON a.id = e.article_id WHERE e.embedding IS NULL")
def needing_embedding(spark, d):
    return store.needing_embedding(views.articles(spark, d), views.extractions(spark, d)).select("article_id", "issue_id", "search_text")


@query("retention_victims", ["issues"], "SELECT id, issue_date FROM issues WHERE id NOT IN (SELECT id FROM issues ORDER BY issue_date DESC LIMIT 3) AND id IS DISTINCT FROM 5")
def retention_victims(spark, d):
    return store.prune_victims(views.issues(spark, d), 3, 5)


@query("retention_cascade", ["extractions", "issues", "feedback"], """, kept AS (SELECT id FROM issues WHERE id IN (SELECT id FROM issues ORDER BY issue_date DESC LIMIT 3)), a AS (SELECT id FROM articles WHERE issue_id IN (SELECT id FROM kept))
    SELECT 'issues' AS relation, id FROM kept UNION ALL SELECT 'articles', id FROM a UNION ALL SELECT 'extractions', article_id FROM extractions WHERE article_id IN (SELECT id FROM a)
    UNION ALL SELECT 'feedback', id FROM feedback WHERE article_id IN (SELECT id FROM a)""")  # fmt: skip
def retention_cascade(spark, d):
    t = _tables(spark, d)
    left = store.delete_issues(t, store.prune_victims(t["issues"], 3))
    ids = {"issues": "id", "articles": "id", "extractions": "article_id", "feedback": "id"}
    return reduce(DataFrame.unionByName, (left[name].select(F.lit(name).alias("relation"), F.col(c).alias("id")) for name, c in ids.items()))


@query("delete_date", ["articles"], "SELECT id, issue_date FROM articles WHERE issue_date <> DATE '2024-01-08'")
def delete_date(spark, d):
    return store.delete_date(_tables(spark, d), F.lit("2024-01-08").cast("date"))["articles"].select("id", "issue_date")


@query("insert_first_wins", ["articles"], """SELECT issue_id, content_hash, min(id) AS id FROM articles a
    WHERE NOT EXISTS (SELECT 1 FROM articles b WHERE b.id % 10 = 0 AND b.issue_id = a.issue_id AND b.content_hash = a.content_hash) GROUP BY ALL""")  # fmt: skip
def insert_first_wins(spark, d):
    a = views.articles(spark, d)
    old = a.filter("id % 10 = 0").select("issue_id", "content_hash")
    return store.first_of_each(a, ["id"]).join(old, ["issue_id", "content_hash"], "left_anti").select("issue_id", "content_hash", "id")


@query("upsert_issues", ["issues"], """, old AS (SELECT * FROM issues WHERE id < 12), new AS (SELECT issue_date, 'new.pdf' AS filename, CASE WHEN id % 2 = 0 THEN pdf_sha256 ELSE 'other' END AS sha FROM issues WHERE id >= 8)
    SELECT coalesce(o.id, (SELECT max(id) FROM old) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY n.issue_date)) AS id, coalesce(o.issue_date, n.issue_date) AS issue_date, coalesce(n.filename, o.filename) AS filename,
    coalesce(n.sha, o.pdf_sha256) AS pdf_sha256, CASE WHEN n.issue_date IS NULL THEN o.status ELSE 'processing' END AS status, CASE WHEN n.issue_date IS NULL THEN o.note END AS note
    FROM old o FULL JOIN new n ON o.issue_date = n.issue_date""")  # fmt: skip
def upsert_issues(spark, d):
    i = views.issues(spark, d)
    new = i.filter("id >= 8").select("issue_date", F.lit("new.pdf").alias("filename"), F.when(F.col("id") % 2 == 0, F.col("pdf_sha256")).otherwise("other").alias("pdf_sha256"), "created_at")
    return store.upsert_issues(i.filter("id < 12"), new)[0].drop("created_at")


@query("changed_issues", ["issues"], "SELECT id FROM issues WHERE id >= 8 AND id < 12 AND id % 2 = 1")
def changed_issues(spark, d):
    i = views.issues(spark, d)
    new = i.filter("id >= 8").select("issue_date", F.lit("new.pdf").alias("filename"), F.when(F.col("id") % 2 == 0, F.col("pdf_sha256")).otherwise("other").alias("pdf_sha256"), "created_at")
    return store.upsert_issues(i.filter("id < 12"), new)[1]


@query("set_prefilter", ["articles"], """SELECT id, CASE WHEN id % 2 = 0 THEN id % 4 = 0 ELSE prefilter_passed END AS prefilter_passed,
    CASE WHEN id % 2 = 1 THEN classify_status WHEN id % 4 = 0 THEN 'pending' ELSE 'skipped' END AS classify_status FROM articles""")  # fmt: skip
def set_prefilter(spark, d):
    a = views.articles(spark, d)
    results = a.filter("id % 2 = 0").select("id", (F.col("id") % 4 == 0).alias("passed"), F.lit(1.0).alias("score"))
    return store.set_prefilter(a, results).select("id", "prefilter_passed", "classify_status")


@query("set_classification", ["articles"], """SELECT id, CASE WHEN id % 4 = 0 THEN 'done' WHEN id % 4 = 1 THEN 'failed' ELSE classify_status END AS classify_status, CASE WHEN id % 4 = 0 THEN true ELSE relevant END AS relevant,
    CASE WHEN id % 4 = 0 THEN 'economy' ELSE category END AS category FROM articles""")  # fmt: skip
def set_classification(spark, d):
    a = views.articles(spark, d)
    results = a.filter("id % 4 < 2").select(
        "id", F.when(F.col("id") % 4 == 0, "done").otherwise("failed").alias("status"), F.lit(True).alias("relevant"), F.lit("economy").alias("category"),
        F.array(F.lit("bpsc")).alias("exam_tags"), F.lit(0.75).alias("score"), F.lit("r").alias("reason"),
    )
    return store.set_classification(a.withColumn("reason", F.lit(None).cast("string")), results).select("id", "classify_status", "relevant", "category")


@query("set_embeddings", ["extractions"], """SELECT article_id, list_sum(list_transform(CASE WHEN article_id % 2 = 0 THEN [0.125, 0.25] ELSE embedding::DOUBLE[] END, lambda x: round(x * 1000))) AS total
    FROM extractions WHERE article_id % 2 = 0 OR embedding IS NOT NULL""")  # fmt: skip
def set_embeddings(spark, d):
    e = views.extractions(spark, d)
    vectors = e.filter("article_id % 2 = 0").select("article_id", F.array(F.lit(0.1250001), F.lit(0.25)).alias("embedding"))
    out = store.set_embeddings(e, vectors).filter("embedding is not null")
    thousandths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000))
    return out.select("article_id", F.aggregate(thousandths, F.lit(0.0), lambda a, b: a + b).alias("total"))


# ---- text ----
@query("content_hash", ["articles"], "SELECT id, content_hash FROM articles")
def content_hash(spark, d):
    return views.documents(spark, d).select("id", T.content_hash(F.col("headline"), F.col("body")).alias("content_hash"))


@query("norm_text", ["docs"], "SELECT id, trim(regexp_replace(lower(text), '[^0-9a-zऀ-ॿ]+', ' ', 'g')) AS normal FROM docs")
def norm_text(spark, d):
    return views.documents(spark, d).select("id", T.norm(F.col("text"), unify=False).alias("normal"))


_NUMBERS = "list_distinct(list_transform(regexp_extract_all({0}, '\\d[\\d,]*\\.?\\d*'), lambda x: rtrim(replace(x, ',', ''), '.')))"


@query("number_sets", ["docs"], f"SELECT id, array_to_string(list_sort({_NUMBERS.format('text')}), ' ') AS numbers FROM docs")
def number_sets(spark, d):
    return views.documents(spark, d).select("id", F.array_join(F.array_sort(T.numbers(F.col("text"))), " ").alias("numbers"))


_CLAIM = "(headline || ' 2024 ' || id)"


@query("unknown_numbers", ["docs"], f"SELECT id, array_to_string(list_sort(list_filter({_NUMBERS.format(_CLAIM)}, lambda x: NOT list_contains({_NUMBERS.format('body')}, x))), ' ') AS missing FROM docs")
def unknown_numbers(spark, d):
    claim = F.concat("headline", F.lit(" 2024 "), F.col("id").cast("string"))
    return views.documents(spark, d).select("id", F.array_join(grounding.unknown_numbers(claim, F.col("body")), " ").alias("missing"))


@query("detect_date", ["docs"], f"""SELECT id, coalesce({twins.printed_date('text')}, CASE WHEN id % 3 = 0 AND id % 28 > 0 THEN CAST(make_date(2024, CAST(id % 12 + 1 AS INTEGER), CAST(id % 28 AS INTEGER)) AS DATE)
    ELSE CAST(try_strptime('2023-' || (id % 12 + 1) || '-' || (id % 31 + 1), '%Y-%m-%d') AS DATE) END) AS detected FROM docs""")  # fmt: skip
def detect_date(spark, d):
    """The text is the first page; a second page and a file name are made from the id."""
    month = F.date_format(F.make_date(F.lit(2024), (F.col("id") % 12 + 1).cast("int"), F.lit(1)), "MMMM")
    second = F.when((F.col("id") % 3 == 0) & (F.col("id") % 28 > 0), F.concat(F.lit("Late City. MONDAY, "), month, F.lit(" "), (F.col("id") % 28).cast("string"), F.lit(", 2024")))
    name = F.concat(F.lit("paper_2023-"), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"), F.lit("_"), F.lpad((F.col("id") % 31 + 1).cast("string"), 2, "0"), F.lit(".pdf"))
    return views.documents(spark, d).select("id", T.issue_date(F.col("text"), second, name).alias("detected"))


_MARKED = "CASE WHEN id % 2 = 0 THEN headline || '. CONTINUED on A Page ' || (id % 30) || '(' || page_no || ') ' || body ELSE text END"


@query("continuation_markers", ["docs"], f""", m AS MATERIALIZED (SELECT id, {_MARKED} AS marked FROM docs)
    SELECT id, {twins.marker_page('marked', T.CONTINUED_ON)} AS page, {twins.without_marker('marked', T.CONTINUED_ON)} AS rest FROM m""")  # fmt: skip
def continuation_markers(spark, d):
    """Every second text gets a marker after its first line."""
    marker = F.concat(F.lit(". CONTINUED on A Page "), (F.col("id") % 30).cast("string"), F.lit("("), F.col("page_no").cast("string"), F.lit(") "))
    marked = F.when(F.col("id") % 2 == 0, F.concat("headline", marker, "body")).otherwise(F.col("text"))
    page, rest = T.pop_marker(F.col("marked"), T.CONTINUED_ON)
    return views.documents(spark, d).select("id", marked.alias("marked")).select("id", page.alias("page"), rest.alias("rest"))


_TOP = "CASE id % 4 WHEN 0 THEN text || chr(10) || 'the world today - sport' WHEN 1 THEN 'x Sport ' || text ELSE text || ' sports worlds' END"


@query("section_detect", ["docs"], f"SELECT id, {twins.section(_TOP)} AS label FROM docs")
def section_detect(spark, d):
    kind = F.col("id") % 4
    top = F.when(kind == 0, F.concat("text", F.lit("\nthe world today - sport"))).when(kind == 1, F.concat(F.lit("x Sport "), "text")).otherwise(F.concat("text", F.lit(" sports worlds")))
    return views.documents(spark, d).select("id", T.section_of(top).alias("label"))


_DIRT = "ﬁne co\u00ad\nop mid\u00addle a-\nb \x01\ufffd"


@query("clean_text", ["docs"], f"SELECT id, {twins.clean(f"""'{_DIRT}' || text""")} AS clean FROM docs")
def clean_text(spark, d):
    """Whole texts after a beginning that has all that is to be cleaned."""
    return views.documents(spark, d).select("id", T.clean_text(F.concat(F.lit(_DIRT), "text")).alias("clean"))


@query("similarity")
def similarity(spark, d):
    """Whole headlines against whole bodies: much work for each row, so rows are dealt to all cores first."""
    docs = views.documents(spark, d).select("id", "headline", "body").repartition(spark.sparkContext.defaultParallelism)
    return docs.select("id", token_set_ratio_udf("headline", "body").alias("token_set"), partial_ratio_udf("headline", "body").alias("part"))


_STRONG = twins.strong_hits(RULES)
_DEFAULTS = prefilter.Rules()


@query("prefilter_score", ["docs"], f"SELECT id, {twins.prefilter_score(RULES)} AS score, {twins.prefilter_score(RULES)} >= 2.0 AND NOT (coalesce(section = 'SPORT', false) AND {_STRONG} < 2) AS passed FROM docs")
def prefilter_score(spark, d):
    return prefilter.prefilter(views.documents(spark, d), replace(RULES, min_score=2.0)).select("id", "score", "passed")


@query("section_skip", ["docs"], f"SELECT section, count(*) AS n FROM docs WHERE NOT (coalesce(section = 'SPORT', false) AND {_STRONG} < 2) GROUP BY ALL")
def section_skip(spark, d):
    return prefilter.prefilter(views.documents(spark, d), RULES).filter("passed").groupBy("section").agg(F.count("*").alias("n"))


# Every fifth headline gets words of the default lists, every 31st a title that is junk.
_HEADED = "headline || CASE WHEN id % 5 = 0 THEN ' Supreme Court grants bail in GDP case, Article 21' ELSE '' END || CASE WHEN id % 31 = 30 THEN ' Crossword' ELSE '' END"


@query("prefilter_defaults", ["docs"], f""", h AS MATERIALIZED (SELECT id, section, body, {_HEADED} AS headline FROM docs), s AS MATERIALIZED (
    SELECT id, section, {twins.has('headline', _DEFAULTS.junk)} AS junk, {twins.prefilter_score(_DEFAULTS)} AS score, {twins.strong_hits(_DEFAULTS)} AS strong, {twins.hits(_DEFAULTS)} AS hits FROM h)
    SELECT id, CASE WHEN junk THEN 0.0 ELSE score END::DOUBLE AS score, NOT junk AND NOT (coalesce(section = 'SPORT', false) AND strong < 2) AS passed, CASE WHEN junk THEN '' ELSE hits END AS hits FROM s""")  # fmt: skip
def prefilter_defaults(spark, d):
    words = F.when(F.col("id") % 5 == 0, " Supreme Court grants bail in GDP case, Article 21").otherwise("")
    docs = views.documents(spark, d).withColumn("headline", F.concat("headline", words, F.when(F.col("id") % 31 == 30, " Crossword").otherwise("")))
    return prefilter.prefilter(docs).select("id", "score", "passed", F.array_join("hits", " ").alias("hits"))


# ---- layout ----
@query("body_size_mode", ["blocks"], """SELECT issue, arg_max(s, {'n': n, 'p': -page, 'b': -block_no}) AS body_size FROM (
    SELECT issue, round_even(size * 2, 0) / 2 AS s, sum(nchars)::BIGINT AS n, min({'p': page, 'b': block_no}).p AS page, min({'p': page, 'b': block_no}).b AS block_no FROM blocks GROUP BY ALL) GROUP BY issue""")  # fmt: skip
def body_size_mode(spark, d):
    return layout.body_size(views.blocks(spark, d))


@query("font_histogram", ["blocks"], """SELECT issue, size, chars, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY chars DESC, size) AS rank FROM (
    SELECT issue, round_even(size * 2, 0) / 2 AS size, sum(nchars)::BIGINT AS chars FROM blocks GROUP BY ALL)) WHERE rank <= 8""")  # fmt: skip
def font_histogram(spark, d):
    return layout.font_histogram(views.blocks(spark, d))


@query("scanned_pages", ["blocks"], "SELECT issue, page, sum(nchars)::BIGINT AS chars FROM blocks GROUP BY ALL HAVING sum(nchars) < 200")
def scanned_pages(spark, d):
    return layout.scanned_pages(views.pages(spark, d), views.blocks(spark, d))


_OVERLAP = "greatest(0.0, least(b.x1, h.x1) - greatest(b.x0, h.x0))"
_ASSIGN = f"""assigned AS (SELECT b.issue, b.page, b.block_no, b.x0, b.y0, b.text, arg_max(h.block_no, {{'y': h.y1, 'i': -h.block_no}}) AS head
    FROM blocks b JOIN blocks h ON h.issue = b.issue AND h.page = b.page AND h.size > 10 AND b.size < 10 AND h.y1 <= b.y0 + 3
    AND ({_OVERLAP} / greatest(b.x1 - b.x0, 1e-6) >= 0.5 OR (b.x0 >= h.x0 - 5 AND b.x0 <= h.x1 + 5)) GROUP BY ALL)"""


def _assigned(spark, d):
    b = views.blocks(spark, d)
    heads = b.filter("size > 10").select("issue", "page", F.col("block_no").alias("head"), "x0", "y0", "x1", "y1")
    return layout.assign(b.filter("size < 10"), heads)


@query("block_assign", ["blocks"], f", {_ASSIGN} SELECT issue, page, CAST(block_no AS INTEGER) AS block_no, CAST(head AS INTEGER) AS head FROM assigned")
def block_assign(spark, d):
    return _assigned(spark, d).select("issue", "page", "block_no", "head")


@query("column_assemble", ["blocks"], f""", {_ASSIGN}, x AS (SELECT *, round_even(x0, 0) AS rx FROM assigned), g AS (
    SELECT *, rx - lag(rx) OVER (PARTITION BY issue, page, head ORDER BY rx) > 15 AS new FROM x), c AS (
    SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY issue, page, head ORDER BY rx RANGE UNBOUNDED PRECEDING) AS col FROM g)
    SELECT issue, page, CAST(head AS INTEGER) AS head, string_agg(text, chr(10) ORDER BY col, y0, block_no) AS body FROM c GROUP BY ALL""")  # fmt: skip
def column_assemble(spark, d):
    return layout.assemble(_assigned(spark, d))


@query("block_build", ["blocks"], f""", {twins.BUILT}, grouped AS (SELECT issue, page, block, g, sum(n * size) / sum(n) AS size, sum(CASE WHEN bold THEN n ELSE 0 END) / sum(n) > 0.6 AS bold, sum(n) AS nchars
    FROM lines JOIN walk USING (issue, page, block, i) GROUP BY ALL)
    SELECT issue, page, CAST(row_number() OVER (PARTITION BY issue, page ORDER BY block, g) - 1 AS INTEGER) AS block_no, size, bold, CAST(nchars AS INTEGER) AS nchars FROM grouped""")  # fmt: skip
def block_build(spark, d):
    """Lines as spans of a block, with sizes that make it split."""
    b = views.blocks(spark, d)
    spans = b.select(
        "issue", "page", F.floor(F.col("block_no") / 6).cast("int").alias("block"), F.col("block_no").alias("line"), F.lit(0).alias("span"), "text",
        F.when(F.col("block_no") % 5 == 0, 14.0).otherwise(9.0).alias("size"), F.when(F.col("block_no") % 2 == 0, 16).otherwise(0).alias("flags"), F.lit("Serif").alias("font"), "x0", "y0", "x1", "y1",
    )
    return layout.blocks(spans).select("issue", "page", "block_no", "size", "bold", "nchars")


@query("segment", ["blocks"], f", {twins.SEGMENTS} SELECT issue, page, head, headline, body, continues_on, continued_from FROM segments")
def segment(spark, d):
    found = layout.articles(views.pages(spark, d), views.blocks(spark, d))
    return found.select("issue", "page", "head", "headline", "body", "continues_on", "continued_from")


@query("stitch")
def stitch(spark, d):
    docs = views.documents(spark, d)
    a = docs.select(
        F.concat(F.lit("i"), F.col("issue_id").cast("string")).alias("issue"), "page_no", F.col("id").cast("int").alias("head"), "headline", "body", "section",
        F.when(F.col("id") % 3 == 0, F.col("page_no") + 1).alias("continues_on"), F.when(F.col("id") % 3 == 1, F.col("page_no") - 1).alias("continued_from"),
    ).withColumnRenamed("page_no", "page")
    return layout.long_enough(layout.stitch(a)).select("issue", "page", "head", "incomplete", F.length("body").alias("chars"))


# The twin has no continuations: it holds where no text prints a marker, so that none is incomplete.
@query("segment_report", ["blocks"], f""", {twins.SEGMENTS}, pages_ AS (SELECT issue, page, sum(nchars) AS chars FROM blocks GROUP BY ALL)
    SELECT p.issue, p.pages, p.scanned_pages, s.body_size, coalesce(a.articles, 0) AS articles, CAST(0 AS BIGINT) AS incomplete
    FROM (SELECT issue, count(*) AS pages, coalesce(string_agg(CASE WHEN chars < 200 THEN page::VARCHAR END, ' ' ORDER BY page), '') AS scanned_pages FROM pages_ GROUP BY issue) p
    JOIN sizes s USING (issue) LEFT JOIN (SELECT issue, count(*) AS articles FROM segments WHERE {twins.n_words('body')} >= 20 GROUP BY issue) a USING (issue)""")  # fmt: skip
def segment_report(spark, d):
    b, p = views.blocks(spark, d), views.pages(spark, d)
    found = layout.articles(p, b).withColumn("section", F.lit(None).cast("string"))  # the report names no sections
    found = layout.written(found)  # stitching reads it several times
    final = layout.long_enough(layout.stitch(found))
    return layout.report(p, b, final).withColumn("scanned_pages", F.array_join(F.col("scanned_pages").cast("array<string>"), " "))


@query("blocks_debug", ["blocks"], f", {twins.BODY_SIZE} SELECT issue, page, CAST(block_no AS INTEGER) AS block_no, size >= body_size * 1.35 AS headline_sized FROM blocks JOIN sizes USING (issue)")
def blocks_debug(spark, d):
    b = views.blocks(spark, d)
    return layout.blocks_debug(b, layout.body_size(b)).select("issue", "page", "block_no", "headline_sized")


# ---- search ----
@query("vector_topk", None, f"""SELECT id, CAST(row_number() OVER (ORDER BY dist, id) - 1 AS INTEGER) AS rank FROM (SELECT vec_id AS id,
    1 - list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS dist
    FROM embeddings, (SELECT {[round(x, 6) for x in VECTOR]}::DOUBLE[] AS q)) ORDER BY rank LIMIT 30""")  # fmt: skip
def vector_topk(spark, d):
    rows = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.vector_rank(rows, VECTOR).select("id", "rank")


_TERMS = "['" + "', '".join(search.query_terms(QUERY, False)) + "']"
_TERM_SQL = f"""terms AS (SELECT id, hits / 10.0::DOUBLE AS score, CAST(row_number() OVER (ORDER BY hits DESC, id) - 1 AS INTEGER) AS rank FROM (SELECT id,
    len(list_filter(regexp_extract_all(lower(headline || chr(10) || body), '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]+'), lambda w: list_contains({_TERMS}, w))) AS hits FROM docs) WHERE hits > 0 ORDER BY rank LIMIT 30)"""


def _searchable(spark, d):
    v = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return views.documents(spark, d).withColumn("search_text", F.concat_ws("\n", "headline", "body")).join(v, "id", "left")


@query("term_rank_or", ["docs"], f", {_TERM_SQL} SELECT id, score, rank FROM terms")
def term_rank_or(spark, d):
    return search.term_rank(_searchable(spark, d), QUERY, stemmed=False)


_VECTOR_SQL = f"""vectors AS (SELECT id, row_number() OVER (ORDER BY dist, id) - 1 AS rank FROM (SELECT d.id,
    1 - list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS dist
    FROM docs d JOIN embeddings e ON e.vec_id = d.id, (SELECT {[round(x, 6) for x in VECTOR]}::DOUBLE[] AS q)) ORDER BY rank LIMIT 30)"""


@query("rrf_fusion", ["docs"], f""", {_TERM_SQL}, {_VECTOR_SQL}, both_ AS (SELECT id, rank, 0 AS list FROM terms UNION ALL SELECT id, rank, 1 FROM vectors)
    SELECT id, CAST(row_number() OVER (ORDER BY score DESC, seen, id) - 1 AS INTEGER) AS rank FROM (
    SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min({{'l': list, 'r': rank}}) AS seen FROM both_ GROUP BY id) ORDER BY rank LIMIT 8""")  # fmt: skip
def rrf_fusion(spark, d):
    rows = _searchable(spark, d)
    return search.fuse([search.term_rank(rows, QUERY, stemmed=False), search.vector_rank(rows, VECTOR)]).select("id", "rank")


_STEMS = "['" + "', '".join(search.query_terms(QUERY)) + "']"


def _stemmed_sql(name: str, text: str, source: str) -> str:
    hits = f"len(list_filter({twins.words(text)}, lambda w: list_contains({_STEMS}, {twins.stem('w')})))"
    return f"{name} AS (SELECT id, hits / 10.0::DOUBLE AS score, CAST(row_number() OVER (ORDER BY hits DESC, id) - 1 AS INTEGER) AS rank FROM (SELECT id, {hits} AS hits FROM {source}) WHERE hits > 0 ORDER BY rank LIMIT 30)"


@query("term_rank_stemmed", ["docs"], f", {_stemmed_sql('stemmed', 'text', 'docs')} SELECT id, score, rank FROM stemmed")
def term_rank_stemmed(spark, d):
    return search.term_rank(_searchable(spark, d), QUERY)


_HYBRID_SQL = f""", english AS MATERIALIZED (SELECT * FROM cards WHERE category = 'en'), {_stemmed_sql('stemmed', 'search_text', 'english')}, near AS (SELECT id, row_number() OVER (ORDER BY dist, id) - 1 AS rank FROM (SELECT id,
    1 - list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS dist
    FROM english, (SELECT {[round(x, 6) for x in VECTOR]}::DOUBLE[] AS q) WHERE embedding IS NOT NULL) ORDER BY rank LIMIT 30),
    fused AS (SELECT id, CAST(row_number() OVER (ORDER BY score DESC, seen, id) - 1 AS INTEGER) AS rank FROM (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min({{'l': list, 'r': rank}}) AS seen
    FROM (SELECT id, rank, 0 AS list FROM stemmed UNION ALL SELECT id, rank, 1 FROM near) GROUP BY id) ORDER BY rank LIMIT 8)"""


def _hybrid(spark, d):
    return search.hybrid_search(_cards(spark, d), QUERY, lambda texts: [VECTOR], where=search.filters(category="en"))


@query("hybrid_search", ["cards"], _HYBRID_SQL + " SELECT f.id, f.rank, headline, issue_date FROM fused f JOIN english USING (id)")
def hybrid_search(spark, d):
    return _hybrid(spark, d).select("id", "rank", "headline", "issue_date")


@query("search_grouped")
def search_grouped(spark, d):
    """Hits of which near-duplicates are one."""
    return search.grouped(_hybrid(spark, d)).select("id", "rank", F.array_join(F.col("also_on_pages").cast("array<string>"), " ").alias("also_on_pages"))


@query("brief_grouped")
def brief_grouped(spark, d):
    """The brief after its filters, with near-duplicates as one."""
    shown = reports.verified(_brief(spark, d).filter(reports.ui_filter(["en", "de"], "general")))
    return search.grouped(shown).select("issue_date", "seq", "id", F.array_join(F.col("also_on_pages").cast("array<string>"), " ").alias("also_on_pages"))


@query("search_text", ["extractions"], """SELECT e.article_id AS id, concat_ws(chr(10), a.headline, summary, key_points[1], key_points[2], exam_relevance, provision, case_name, court) AS search_text
    FROM extractions e JOIN articles a ON a.id = e.article_id""")  # fmt: skip
def search_text(spark, d):
    return _cards(spark, d).select("id", grounding.search_text(F.col("headline"), F.col("data")).alias("search_text"))


@query("answer_context", ["cards"], """SELECT CAST(n AS INTEGER) AS n, '[' || n || '] (' || issue_date || ', p.' || page_no || ') ' || headline || chr(10) || summary || chr(10) || '- ' || key_points[1] || chr(10) || '- ' || key_points[2] AS note
    FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS n FROM cards) WHERE n <= 6""")  # fmt: skip
def answer_context(spark, d):
    hits = _cards(spark, d).orderBy(F.desc("id")).limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("id"))))
    return search.answer_context(hits)


@query("cards_in_order", ["cards"], f", {_VECTOR_SQL} SELECT id, headline, CAST(rank AS INTEGER) AS rank FROM cards JOIN vectors USING (id)")
def cards_in_order(spark, d):
    """Of the documents nearest to a vector those that are cards, by nearness."""
    return search.in_order(_cards(spark, d), search.vector_rank(_searchable(spark, d), VECTOR)).select("id", "headline", "rank")


# ---- duplicates, grounding, evaluation, enrichment ----
@query("dedup_exact", ["docs"], """SELECT issue_date, arg_min(id, {'l': -length(body), 'i': id}) AS id, count(*) AS copies FROM docs GROUP BY issue_date, headline, body""")
def dedup_exact(spark, d):
    order = F.struct((-F.length("body")).alias("l"), F.col("id").alias("i"))
    return views.documents(spark, d).groupBy("issue_date", "headline", "body").agg(F.min_by("id", order).alias("id"), F.count("*").alias("copies")).select("issue_date", "id", "copies")


@query("dedup_fuzzy")
def dedup_fuzzy(spark, d):
    out = dedup.group_duplicates(views.documents(spark, d).select("id", "issue_date", "headline", "body", "page_no"), ["id"])
    return out.select("id", "issue_date", "page_no", F.array_join(F.col("also_on_pages").cast("array<string>"), " ").alias("also_on_pages"))


@query("grounding")
def grounded(spark, d):
    rows = _cards(spark, d).select("id", "body", "data", F.col("validation_status").alias("_s")).drop("_s")
    return grounding.validate(rows).select("id", "status", F.array_join("warnings", "; ").alias("warnings"), F.size("data.evidence").alias("quotes"), F.size("data.provisions").alias("provisions"))


@query("grounding_exact", ["docs"], """, h AS MATERIALIZED (SELECT id, trim(regexp_replace(lower(text), '[^0-9a-zऀ-ॿ]+', ' ', 'g')) AS hay FROM docs),
    n AS MATERIALIZED (SELECT item_id, trim(regexp_replace(lower(text), '[^0-9a-zऀ-ॿ]+', ' ', 'g')) AS needle FROM benchmark)
    SELECT DISTINCT id, item_id FROM h, n WHERE needle <> '' AND contains(hay, needle)""")  # fmt: skip
def grounding_exact(spark, d):
    """Which benchmark passages texts hold verbatim."""
    docs = views.documents(spark, d).select("id", T.norm(F.col("text"), unify=False).alias("text"))
    items = views.read(spark, d, "benchmark").select("item_id", T.norm(F.col("text"), unify=False).alias("needle"))
    return grounding.holding(docs, items)


@query("label_export", ["articles"], "SELECT issue_date, content_hash, page_no, headline, left(body, 250) AS snippet, '' AS human FROM articles")
def label_export(spark, d):
    return evaluate.label_export(views.articles(spark, d).drop("issue_date"), views.issues(spark, d))


_GOLD = "gold AS (SELECT content_hash, arg_max(CAST(toxic AS INTEGER), id) AS gold FROM articles WHERE toxic IS NOT NULL GROUP BY content_hash)"


@query("eval_prf", ["articles"], f""", {_GOLD}, n AS (SELECT count(*) AS labelled, count(*) FILTER (WHERE gold = 1) AS positives, count(*) FILTER (WHERE gold = 1 AND coalesce(prefilter_passed, false)) AS passed,
    count(*) FILTER (WHERE coalesce(relevant, false) AND gold = 1) AS tp, count(*) FILTER (WHERE coalesce(relevant, false) AND gold = 0) AS fp, count(*) FILTER (WHERE NOT coalesce(relevant, false) AND gold = 1) AS fn
    FROM articles JOIN gold USING (content_hash)), m AS (SELECT *, passed / greatest(positives, 1)::DOUBLE AS prefilter_recall, tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(tp + fn, 1)::DOUBLE AS recall FROM n)
    SELECT labelled, positives, prefilter_recall, tp, fp, fn, precision, recall, 2 * precision * recall / greatest(precision + recall, 1e-9) AS f1 FROM m""")  # fmt: skip
def eval_prf(spark, d):
    a = views.articles(spark, d)
    labels = a.filter("toxic is not null").select("content_hash", F.concat(F.lit(" "), F.col("toxic").cast("string")).alias("human"), F.lit(0).alias("file_no"), F.col("id").alias("row_no"))
    return evaluate.scores(a, evaluate.gold(labels))


@query("json_fence_parse", ["docs"], "SELECT id, CASE WHEN id % 4 <> 3 THEN CAST(id AS INTEGER) END AS number, CASE WHEN id % 4 <> 3 THEN category END AS lang FROM docs")
def json_fence_parse(spark, d):
    fence = F.when(F.col("id") % 2 == 0, "```json\n").otherwise("")
    end = F.when(F.col("id") % 2 == 0, "\n```").when(F.col("id") % 4 == 3, "}}").otherwise("")
    text = F.concat(fence, F.when(F.col("id") % 4 == 3, "{{"), F.to_json(F.struct("id", "category")), end)
    text = F.coalesce(text, F.concat(fence, F.to_json(F.struct("id", "category")), end))
    parsed = calls.parsed(text, "id int, category string")
    return views.documents(spark, d).select("id", parsed["id"].alias("number"), parsed["category"].alias("lang"))


@query("validate_items", ["docs"], "SELECT id, id % 3 <> 0 AND n_chars % 10 <= 5 AND length(headline) <= 300 AS valid FROM docs")
def validate_items(spark, d):
    item = F.struct(
        F.col("id").cast("int").alias("id"), F.lit(True).alias("relevant"), F.when(F.col("id") % 3 != 0, "economy").otherwise("Economy").alias("category"),
        F.array(F.lit("upsc")).alias("exam_tags"), ((F.col("n_chars") % 10) / 5.0).alias("score"), F.col("headline").alias("reason"),
    )
    return views.documents(spark, d).select("id", schemas.valid_batch(F.array(item)).alias("valid"))


def _rule_provider(messages: list[calls.Message]) -> str:
    """Answers by rule, for offline runs: an article is relevant if its number is even."""
    import json
    import re

    numbers = re.findall(r"(?m)^\[(\d+)\] HEADLINE", messages[-1]["content"])
    items = [{"id": int(n), "relevant": int(n) % 2 == 0, "category": "other", "exam_tags": ["general"], "score": 0.9, "reason": "rule"} for n in numbers]
    return json.dumps({"items": items})


@query("classify_rule", ["articles"], f"""SELECT id, 'done' AS status, (seq - 1) % 8 % 2 = 0 AS relevant, 'other' AS category, 0.9::DOUBLE AS score
    FROM (SELECT *, {_WORK} AS seq FROM articles WHERE prefilter_passed AND classify_status IN ('pending', 'failed'))""")  # fmt: skip
def classify_rule(spark, d):
    due = store.pending_classify(views.articles(spark, d))
    return enrich.classify(due, calls.Providers((("rule", _rule_provider),)), "rule").select("id", "status", "relevant", "category", "score")


# ---- full text over stored vectors ----
_WORDS_SQL = """texts AS (SELECT article_id AS id, unnest(regexp_extract_all(lower(search_text), '[\\p{L}\\p{N}\\x{0900}-\\x{097F}]+')) AS w, generate_subscripts(regexp_extract_all(lower(search_text), '[\\p{L}\\p{N}\\x{0900}-\\x{097F}]+'), 1) AS p FROM extractions),
  kept AS (SELECT * FROM texts WHERE w NOT IN (STOP)), ws AS (SELECT DISTINCT w FROM kept), STEMS,
  vector AS (SELECT id, stem AS term, p FROM kept JOIN stems USING (w))""".replace("STOP", ", ".join(f"'{w}'" for w in sorted(stems.STOP))).replace("STEMS", stems.stem_sql("ws"))


def _sql_ctes(body: str) -> str:
    return views.with_views(["extractions"], "").rstrip() + ",\n" + _WORDS_SQL + "\n" + body


def _vectors(spark, d):
    rows = views.extractions(spark, d).select(F.col("article_id").alias("id"), "search_text")
    return fulltext.with_vectors(rows).drop("search_text")


@query("search_vectors", sql=_sql_ctes("SELECT id, term, string_agg(p, ',' ORDER BY p) AS positions FROM vector GROUP BY id, term"))
def search_vectors(spark, d):
    """The stored vectors, a row a term."""
    return _vectors(spark, d).select("id", F.explode("tsv").alias("t")).select("id", "t.term", F.array_join(F.col("t.positions").cast("array<string>"), ",").alias("positions"))


@query("cover_rank_any", sql=_sql_ctes("""SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM
    (SELECT id, round(count(*) * 0.1, 6) AS score FROM vector WHERE term IN ('licens', 'version', 'public') GROUP BY id ORDER BY score DESC, id LIMIT 30)"""))  # fmt: skip
def cover_rank_any(spark, d):
    """A question in words: any of them counts."""
    return fulltext.search(_vectors(spark, d), fulltext.any_of("Is this the licensed version of the public?"))


@query("cover_rank_all", sql=_sql_ctes("""SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM (SELECT id, round(sum(0.1::DOUBLE / (1 + (p - p0) - (n - n0))), 6) AS score FROM
    (SELECT *, max(p0) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM
      (SELECT *, least(la, lb).p AS p0, least(la, lb).n AS n0 FROM
        (SELECT id, p, n, max(CASE WHEN term = 'licens' THEN {'p': p, 'n': n} END) OVER w AS la, max(CASE WHEN term = 'version' THEN {'p': p, 'n': n} END) OVER w AS lb FROM
          (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS n FROM vector WHERE term IN ('licens', 'version')) WINDOW w AS (PARTITION BY id ORDER BY n))
       WHERE la IS NOT NULL AND lb IS NOT NULL))
    WHERE before IS NULL OR p0 > before GROUP BY id ORDER BY score DESC, id LIMIT 30)"""))  # fmt: skip
def cover_rank_all(spark, d):
    """Both words, the nearer to each other the better."""
    return fulltext.search(_vectors(spark, d), fulltext.all_of("licensing versions"))


@query("index_search")
def index_search(spark, d):
    """The same question as cover_rank_any, put to an index of postings that is written first."""
    rows = views.extractions(spark, d).select(F.col("article_id").alias("id"), "search_text")
    rows = fulltext.with_vectors(rows).join(views.articles(spark, d).select("id", "issue_id"), "id")
    index = fulltext.Index(spark, f"{new_folder(spark)}/postings", 8)
    index.replace(rows, rows.select("issue_id"))
    return index.search(fulltext.any_of("Is this the licensed version of the public?"))


# ---- similarity of short texts, as clients have them ----
_NORMAL = "trim(regexp_replace(lower({}), '[^0-9a-zऀ-ॿ]+', ' ', 'g'))"


def _client_names(spark, d):
    c = views.read(spark, d, "clients").select("client_id", "master_id", F.coalesce("name", F.lit("")).alias("name"))
    m = c.groupBy(F.col("client_id").alias("master_id")).agg(F.min("name").alias("master"))
    return c.join(m, "master_id", "left").select("client_id", "name", F.coalesce("master", F.lit("")).alias("master"))


@query("client_names", sql=f"""WITH RECURSIVE named AS (SELECT c.client_id AS k, coalesce(c.name, '') AS a, coalesce(m.name, '') AS b FROM clients c LEFT JOIN clients m ON m.client_id = c.master_id),
  plain AS (SELECT k, {_NORMAL.format("a")} AS a, {_NORMAL.format("b")} AS b FROM named),
  {twins.token_sides("sides", "named")}, {twins.stretches("parts", "named")}, {twins.stretches("plain_parts", "plain")},
  asked AS (SELECT l AS a, r AS b FROM sides UNION SELECT s, w FROM parts UNION SELECT s, w FROM plain_parts), {twins.LCS},
  best AS (SELECT k, max(200.0::DOUBLE * n / (len(s) + len(w))) AS v FROM parts JOIN lcs ON a = s AND b = w GROUP BY k),
  plain_best AS (SELECT k, max(200.0::DOUBLE * n / (len(s) + len(w))) AS v FROM plain_parts JOIN lcs ON a = s AND b = w GROUP BY k)
  SELECT k AS client_id, {twins.token_set("lcs.n")} AS token_set, CASE WHEN named.a = '' OR named.b = '' THEN CASE WHEN named.a = named.b THEN 100.0 ELSE 0.0 END ELSE best.v END::DOUBLE AS part,
    plain.a <> '' AND (contains(plain.b, plain.a) OR (len(plain.a) >= 6 AND coalesce(plain_best.v, 0) >= 88)) AS present
  FROM named JOIN sides USING (k) JOIN plain USING (k) JOIN lcs ON lcs.a = l AND lcs.b = r LEFT JOIN best USING (k) LEFT JOIN plain_best USING (k)""")  # fmt: skip
def client_names(spark, d):
    """How near each client's name is to that of its master: by words, by its best stretch, and as a claim about it."""
    c = _client_names(spark, d)
    held = grounding.present_each(F.array("name"), T.norm(F.col("master")), 88)[0]
    return c.select("client_id", token_set_ratio_udf("name", "master").alias("token_set"), partial_ratio_udf("name", "master").alias("part"), held.alias("present"))


_LIKE = dedup.Duplicates(headline=60, body=60)


@query("client_groups", sql=f"""WITH RECURSIVE rows_ AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY len(body) DESC, client_id) AS v FROM
    (SELECT client_id, CAST(updated_at AS DATE) AS day, nation_id, coalesce(name, '') AS name, concat_ws(' ', city, segment, source) AS body FROM clients)),
  met AS (SELECT p.day, p.v, q.v AS e, p.name AS n1, q.name AS n2, p.body AS b1, q.body AS b2 FROM rows_ p JOIN rows_ q ON q.day IS NOT DISTINCT FROM p.day AND q.v < p.v),
  texts AS (SELECT row_number() OVER () AS k, a, b FROM (SELECT n1 AS a, n2 AS b FROM met UNION SELECT b1, b2 FROM met)),
  {twins.token_sides("sides", "texts")}, asked AS (SELECT DISTINCT l AS a, r AS b FROM sides), {twins.LCS},
  near AS (SELECT t.a, t.b FROM texts t JOIN sides USING (k) JOIN lcs ON lcs.a = l AND lcs.b = r WHERE {twins.token_set("lcs.n")} >= 60),
  alike AS (SELECT day, v, list(e) AS es FROM met WHERE EXISTS (SELECT 1 FROM near WHERE a = n1 AND b = n2) AND EXISTS (SELECT 1 FROM near WHERE a = b1 AND b = b2) GROUP BY ALL),
  turns AS (SELECT r.day, r.v, coalesce(es, []) AS es FROM rows_ r LEFT JOIN alike a ON a.day IS NOT DISTINCT FROM r.day AND a.v = r.v),
  led AS (SELECT DISTINCT day, 0::BIGINT AS v, []::BIGINT[] AS leaders, NULL::BIGINT AS leader FROM rows_ UNION ALL
    SELECT day, v, CASE WHEN first IS NULL THEN list_append(leaders, v) ELSE leaders END, coalesce(first, v) FROM
      (SELECT w.day, t.v, w.leaders, list_filter(w.leaders, lambda x: list_contains(t.es, x))[1] AS first FROM led w JOIN turns t ON t.day IS NOT DISTINCT FROM w.day AND t.v = w.v + 1)),
  groups AS (SELECT l.day, l.leader, r.client_id, r.nation_id, l.v = l.leader AS keeps FROM led l JOIN rows_ r ON r.day IS NOT DISTINCT FROM l.day AND r.v = l.v)
  SELECT min(CASE WHEN keeps THEN client_id END) AS client_id, coalesce(string_agg(CASE WHEN NOT keeps THEN nation_id::VARCHAR END, ',' ORDER BY nation_id), '') AS also FROM groups GROUP BY day, leader""")  # fmt: skip
def client_groups(spark, d):
    """Clients of a day with names and descriptions that are alike, grouped like stories that are printed twice."""
    c = views.read(spark, d, "clients").select(
        "client_id", F.col("updated_at").cast("date").alias("issue_date"), F.col("nation_id").alias("page_no"), F.coalesce("name", F.lit("")).alias("headline"), F.concat_ws(" ", "city", "segment", "source").alias("body"),
    )
    return dedup.group_duplicates(c, ["client_id"], _LIKE).select("client_id", F.array_join(F.col("also_on_pages").cast("array<string>"), ",").alias("also"))
