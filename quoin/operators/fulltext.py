"""Full text over stored search vectors: cover-density rank, and an index of postings that a query reads in part.

A query is alternatives of terms that must all occur: [["court"], ["bail", "appeal"]] asks for court, or for bail and
appeal both.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.functions.stems import STOP, search_vector, stem, tokens

WEIGHT = 0.1  # Fixed value: of a word that stands in no marked part of its text
POSTINGS = "term string, id bigint, positions array<int>, issue_id bigint, bucket int"


def any_of(query: str) -> list[list[str]]:
    """Every word of the query is an alternative; stop words are none."""
    return [[t] for t in _terms(query)]


def all_of(query: str) -> list[list[str]]:
    return [terms] if (terms := _terms(query)) else []


def web_query(query: str) -> list[list[str]]:
    """Words that must all occur, in alternatives parted by the word "or"."""
    return [terms for part in re.split(r"(?i)\bor\b", query) if (terms := _terms(part))]


def _terms(text: str) -> list[str]:
    return list(dict.fromkeys(stem(w) for w in tokens(text) if w not in STOP))


def with_vectors(rows: DataFrame, text: str = "search_text") -> DataFrame:
    """Adds `tsv`, to be kept with the rows: what later queries read in place of the texts."""
    return rows.withColumn("tsv", search_vector(F.col(text)))


def matches(tsv: Column, query: list[list[str]]) -> Column:
    """A row holds all terms of an alternative. Null vectors hold none."""
    terms = F.transform(tsv, lambda t: t["term"])
    tests = [reduce(lambda a, b: a & b, (F.array_contains(terms, t) for t in dict.fromkeys(all_))) for all_ in query]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def cover_rank(tsv: Column, query: list[list[str]]) -> Column:
    """The sum over the smallest covers, stretches that satisfy the query and hold no shorter one that does: each counts the
    weight, divided by one more than the other words inside it.

    One fold over the query's words in the order of their positions: for each term its last place. A cover ends where the
    latest possible begin moves on."""
    terms = list(dict.fromkeys(t for all_ in query for t in all_))
    if not terms:
        return F.lit(0.0)
    number = F.create_map(*(F.lit(x) for i, t in enumerate(terms) for x in (t, i)))
    asked = F.filter(tsv, lambda t: t["term"].isin(terms))
    places = F.array_sort(F.flatten(F.transform(asked, lambda t: F.transform(t["positions"], lambda p: F.struct(p.alias("p"), number[t["term"]].alias("t"))))))

    def step(state: Column, x: Column) -> Column:
        n = state["n"] + 1
        last = F.transform(state["last"], lambda old, i: F.when(i == x["t"], F.struct(x["p"].alias("p"), n.alias("n"))).otherwise(old))
        ways = [reduce(F.least, (last[terms.index(t)] for t in all_)) if len(all_) > 1 else last[terms.index(all_[0])] for all_ in query]
        begin = reduce(F.greatest, ways) if len(ways) > 1 else ways[0]
        fresh = begin["n"] > state["begin"]
        others = (x["p"] - begin["p"]) - (n - begin["n"])
        score = state["score"] + F.when(fresh, WEIGHT / (1 + others)).otherwise(0.0)
        return F.struct(last.alias("last"), n.alias("n"), F.when(fresh, begin["n"]).otherwise(state["begin"]).alias("begin"), score.alias("score"))

    none = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"))  # a term not yet met: no begin at all
    start = F.struct(F.array(*(none for _ in terms)).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("begin"), F.lit(0.0).alias("score"))
    return F.aggregate(F.coalesce(places, F.array().cast("array<struct<p: int, t: int>>")), start, step, lambda s: s["score"])


def search(rows: DataFrame, query: list[list[str]], limit: int = 30, where: Column | None = None) -> DataFrame:
    """rows: id and tsv. id, score (to six decimals), rank (from 0) of the best; equal scores by id."""
    found = rows if where is None else rows.filter(where)
    scored = found.filter(matches(F.col("tsv"), query)).select("id", F.round(cover_rank(F.col("tsv"), query), 6).alias("score"))
    return ranked(scored, limit)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    top = scored.orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


@dataclass(frozen=True)
class Index:
    """Postings in folders by issue and by bucket of the term, sorted by term in each file. A search reads the files
    of its terms' buckets (and of the issues it is limited to), and of these the row groups that may hold the terms.
    Replacing an issue rewrites that issue's folders alone."""

    spark: SparkSession
    folder: str
    buckets: int = 64

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def replace(self, rows: DataFrame, issues: DataFrame) -> None:
        """rows: id, issue_id, tsv: everything that the `issues` (issue_id) now hold; an issue without rows is emptied.
        Every bucket of a touched issue gets a row without term, so that none keeps old postings."""
        found = rows.join(issues.select("issue_id").distinct(), "issue_id", "left_semi").select("issue_id", "id", F.explode("tsv").alias("t"))
        postings = found.select("t.term", "id", "t.positions", "issue_id", self._bucket(F.col("t.term")).alias("bucket"))
        marks = issues.select("issue_id").distinct().select(
            F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("array<int>").alias("positions"),
            F.col("issue_id").cast("bigint").alias("issue_id"), F.explode(F.sequence(F.lit(0), F.lit(self.buckets - 1))).alias("bucket"),
        )
        # rebalance: a bucket of a large issue becomes several files instead of one long task
        dealt = postings.unionByName(marks).hint("rebalance", F.col("issue_id"), F.col("bucket")).sortWithinPartitions("issue_id", "bucket", "term", "id")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("issue_id", "bucket").parquet(self.folder)

    def postings(self, query: list[list[str]], issues: list[int] | None = None) -> DataFrame:
        """The postings of the query's terms."""
        terms = list(dict.fromkeys(t for all_ in query for t in all_))
        rows = self.spark.read.schema(POSTINGS).parquet(self.folder)
        buckets = [r.bucket for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term")).alias("bucket")).distinct().collect()] if terms else []
        found = rows.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)) if terms else rows.filter("false")
        return found if issues is None else found.filter(F.col("issue_id").isin(issues))

    def search(self, query: list[list[str]], limit: int = 30, issues: list[int] | None = None) -> DataFrame:
        """The same answer as `search` over all rows."""
        own = self.postings(query, issues).groupBy("id").agg(F.collect_list(F.struct("term", "positions")).alias("tsv"))  # a row a term of the query
        return search(own, query, limit)
