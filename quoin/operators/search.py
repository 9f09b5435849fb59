"""Hybrid search: OR-of-terms ranking, exact cosine neighbours, reciprocal rank fusion."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.operators import fulltext
from quoin.operators.dedup import group_duplicates
from quoin.operators.layout import written

# English words that say nothing alone.
STOPWORDS = frozenset(
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each "
    "few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or "
    "other our out over own same she so some such than that the their them then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with you your".split()
)


def cards(articles: DataFrame, issues: DataFrame, extractions: DataFrame) -> DataFrame:
    """Articles with an extraction, and their issue's date."""
    a = articles.select("id", "issue_id", "page_no", "headline", "body", "category", "exam_tags", "relevance_score", "incomplete")
    i = issues.select(F.col("id").alias("issue_id"), "issue_date")
    e = extractions.select(F.col("article_id").alias("id"), "data", "validation_status", "warnings", "search_text", "embedding", *(c for c in ("tsv",) if c in extractions.columns))
    return a.join(i, "issue_id").join(e, "id").drop("issue_id")


def filters(date_from: date | None = None, date_to: date | None = None, category: str | None = None, tag: str | None = None) -> Column:
    """Both dates inclusive; what is empty doesn't filter."""
    tests = []
    if date_from:
        tests.append(F.col("issue_date") >= F.lit(date_from))
    if date_to:
        tests.append(F.col("issue_date") <= F.lit(date_to))
    if category:
        tests.append(F.col("category") == category)
    if tag:
        tests.append(F.array_contains("exam_tags", tag))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def stem(word: str) -> str:
    """A light English stemmer: plurals, then -ing and -ed where a vowel is left before them."""
    w = word.lower()
    if len(w) > 4 and w.endswith("ies"):
        w = w[:-3] + "y"
    elif len(w) > 4 and re.search(r"(?:s|x|z|ch|sh)es$", w):
        w = w[:-2]
    elif len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
        w = w[:-1]
    for end in ("ing", "ed"):
        root = w[: -len(end)]
        if w.endswith(end) and len(root) > 2 and re.search("[aeiouy]", root):
            w = root[:-1] if len(root) > 3 and root[-1] == root[-2] and root[-1] not in "lsz" else root
            break
    return w


def stem_of(w: Column) -> Column:
    """The same in the JVM, for a word in lower case."""
    singular = F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.left(w, F.length(w) - 3), F.lit("y")))
    singular = singular.when((F.length(w) > 4) & w.rlike("(?:s|x|z|ch|sh)es$"), F.left(w, F.length(w) - 2))
    singular = singular.when((F.length(w) > 3) & w.endswith("s") & ~w.rlike("(?:ss|us|is)$"), F.left(w, F.length(w) - 1)).otherwise(w)

    def undoubled(root: Column) -> Column:
        last = F.right(root, F.lit(1))
        twice = (F.length(root) > 3) & (last == F.substr(root, F.length(root) - 1, F.lit(1))) & ~last.isin("l", "s", "z")
        return F.when(twice, F.left(root, F.length(root) - 1)).otherwise(root)

    def verb(w: Column) -> Column:
        out = None
        for end in ("ing", "ed"):
            root = F.left(w, F.length(w) - len(end))
            fits = w.endswith(end) & (F.length(root) > 2) & root.rlike("[aeiouy]")
            out = F.when(fits, undoubled(root)) if out is None else out.when(fits, undoubled(root))
        return out.otherwise(w)

    return F.transform(F.array(singular), verb)[0]


def query_terms(query: str, stemmed: bool = True) -> list[str]:
    """The query's words, without stop words, in their order and once each."""
    words = [w.lower() for w in re.findall(r"[^\W_]+(?:[ऀ-ॿ]*)", query)]
    return list(dict.fromkeys(stem(w) if stemmed else w for w in words if w not in STOPWORDS))


def term_rank(rows: DataFrame, query: str, limit: int = 30, where: Column | None = None, stemmed: bool = True) -> DataFrame:
    """id, score, rank (from 0) of the rows whose search_text holds any term. A score is a tenth of the number of
    positions that match; equal scores go by id. A query without terms finds nothing."""
    terms = query_terms(query, stemmed)
    found = rows.filter(F.lit(bool(terms))) if where is None else rows.filter(where & F.lit(bool(terms)))
    words = F.filter(F.split(F.lower(F.coalesce("search_text", F.lit(""))), r"(?U)[^\w]+"), lambda w: w != "")
    words = F.transform(words, stem_of) if stemmed else words
    hits = F.size(F.filter(words, lambda w: w.isin(*(terms or [""]))))
    scored = found.select("id", hits.alias("hits")).filter("hits > 0").select("id", (F.col("hits") / 10.0).alias("score"))
    return _top(scored, F.desc("score"), limit)


def cosine_distance(vector: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = sum(x * x for x in query) ** 0.5
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double")))
    return 1 - F.try_divide(dot, own * F.lit(norm))


def vector_rank(rows: DataFrame, query: list[float] | None, limit: int = 30, where: Column | None = None) -> DataFrame:
    """id, score (cosine distance), rank. Exact; rows without a vector, and all rows without a query vector, are
    out. The query is rounded to six decimals as stored vectors are."""
    usable = rows.filter(F.col("embedding").isNotNull() & F.lit(query is not None))
    usable = usable if where is None else usable.filter(where)
    distance = cosine_distance(F.col("embedding"), [round(x, 6) for x in query or [1.0]])
    return _top(usable.select("id", distance.alias("score")).filter("score is not null"), F.asc("score"), limit)


def _top(scored: DataFrame, by: Column, limit: int) -> DataFrame:
    top = scored.orderBy(by, "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(by, "id")) - 1)


def fuse(rankings: list[DataFrame], k: int = 8, constant: float = 60.0) -> DataFrame:
    """id, score, rank by the sum of 1 / (constant + rank). Equal sums go to the one first seen: earlier list, then
    earlier rank."""
    lists = [r.select("id", "rank", F.lit(n).alias("list")) for n, r in enumerate(rankings)]
    both = reduce(DataFrame.unionByName, lists)
    sums = both.groupBy("id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("_seen"))
    order = (F.desc("score"), "_seen", "id")
    top = sums.orderBy(*order).limit(k)
    return top.select("id", "score", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


def in_order(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with these ids, with their rank; ids: id, rank."""
    return rows.join(F.broadcast(ids.select("id", "rank")), "id").orderBy("rank")


def hybrid_search(rows: DataFrame, query: str, embed: Callable[[list[str]], list[list[float]] | None] | None = None, k: int = 8, where: Column | None = None) -> DataFrame:
    """Cards in fused order. Both legs filter before their limit; without a query vector only terms count. Rows with
    stored vectors (tsv) are ranked by these, others by their texts."""
    vectors = embed([query]) if embed else None
    rankings = [fulltext.search(rows, fulltext.any_of(query), where=where) if "tsv" in rows.columns else term_rank(rows, query, where=where)]
    if vectors:
        rankings.append(vector_rank(rows, vectors[0], where=where))
    return in_order(rows, fuse(rankings, k))


def grouped(hits: DataFrame) -> DataFrame:
    """Hits, or a brief's cards, with near-duplicates as one, in their order (rank or seq). This comes after all
    filters and the choice of hits, so there may be fewer. What was searched for is written, as grouping reads it several
    times."""
    order = "rank" if "rank" in hits.columns else "seq"
    return group_duplicates(written(hits), [order]).orderBy(order)


NO_HITS = "No matching notes found."
ANSWER_SYSTEM = "Every statement of your reply rests on a note below and ends with that note's number in brackets. Where no note covers the question, tell the reader that."


def answer_context(hits: DataFrame, most: int = 6) -> DataFrame:
    """n and note: the numbered notes of the first hits."""
    top = hits.orderBy("rank").limit(most)
    n = F.row_number().over(Window.orderBy("rank"))
    head = F.concat(F.lit("["), n.cast("string"), F.lit("] ("), F.col("issue_date").cast("string"), F.lit(", p."), F.col("page_no").cast("string"), F.lit(") "), F.col("headline"))
    note = F.concat_ws("\n", head, F.col("data.summary"), F.concat(F.lit("- "), F.array_join("data.key_points", "\n- ")))
    return top.select(n.alias("n"), note.alias("note"))


def answer(question: str, hits: DataFrame, respond: Callable[[str, str], str], system: str = ANSWER_SYSTEM) -> str:
    """respond: from a system prompt and the question with its notes to the reply."""
    notes = [r.note for r in answer_context(hits).orderBy("n").collect()]  # six rows at most
    return respond(system, f"QUESTION: {question}\n\nNOTES:\n" + "\n\n".join(notes)) if notes else NO_HITS
