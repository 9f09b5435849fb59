"""How far the words of a source stand from those of its language, and sources of a language from each other.

Probabilities are whole billionths, so all arithmetic is exact: p of a term in a group is 1 + floor(10^9 (count + 1) /
(N + V)), with N the group's occurrences of kept terms and V the number of terms that the language keeps; the
divergence of p from q is f = floor((p - q)^2 / q).

Top terms of a group: its terms are bucketed by their counts there. The largest p of a bucket against the least
probability that any of its terms has in the language bounds f from above. The buckets of highest bound that hold k
terms are evaluated first; then every other bucket whose bound is not strictly below the k-th value found so far.

Pairs of sources: two groups differ in each kept term. What a term adds depends on its two counts alone, so a pair
starts as V times the value of two zeros; a histogram of each group's counts puts right what is not zero on one side,
and the postings (for each term its sources and counts) what is not zero on both.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import cut, pick, read

COLUMNS = {"text": "string", "lang": "string", "source": "string"}
SCALE = 1_000_000_000
HELD = 400_000  # counts that a task holds before it hands them on
MOST_GROUPS = 1 << 13  # of one language, up to which a task sums pairs in an array; with more, pairs are joined
MOST_BUCKETS = 1 << 20  # broadcast up to so many rows of three numbers and two names

# Letters of ASCII in lower case, bytes of other characters as they are, a space for all else.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count and docs (documents that hold it), in parts that are still to be added up; a row
    with a null term for every group that occurs. A task counts what it reads before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in counts.items():
                n = len(times)
                terms = pa.array([*times, None], pa.binary()).cast(pa.string())
                both = [pa.array([*times.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, times), 0], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (n + 1), pa.string()), pa.array([source] * (n + 1), pa.string()), terms, *both], ["lang", "source", "term", "count", "docs"])
            counts.clear()

        held = 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for text, lang, source in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                terms = text.as_py().translate(LETTERS).split()
                times, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                before = len(times)
                times.update(terms)
                docs.update(set(terms))
                held += len(times) - before
            if held > HELD:
                yield from flush()
                held = 0
        yield from flush()

    texts = pick(docs, COLUMNS).select(*(F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS))
    return texts.mapInArrow(count, "lang string, source string, term string, count bigint, docs bigint")


def probability(count: Column, total: Column, kept: Column) -> Column:
    """In billionths; as decimals, since a count of nine milliards times a milliard is beyond a long."""
    n = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.expr("1L") + F.call_function("div", n, (total + kept).cast("decimal(19,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """The kept terms' counts by group, written once, and each group's and language's totals."""

    def __init__(self, docs: DataFrame, least_docs: int = 3):
        summed = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
        postings = summed.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "count")).alias("at"), F.sum("count").alias("in_lang"), F.sum("docs").alias("docs"))
        # a list is as long as a language has sources; terms of too few documents go, the groups' own rows stay
        kept = postings.filter((F.col("docs") >= least_docs) | F.col("term").isNull())
        self.postings = cut(kept.select("lang", "term", "at", "in_lang"))
        flat = self.postings.select("lang", "term", "in_lang", F.explode("at").alias("_at")).select("lang", "term", "in_lang", "_at.source", "_at.count")
        self.counts = flat.filter("term is not null")
        totals = flat.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        langs = self.postings.groupBy("lang").agg(F.count("term").alias("kept"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("in_lang"))), F.lit(0)).alias("lang_total"))
        self.groups = cut(totals.join(F.broadcast(langs), "lang"))  # a row a language


def few(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bucket(count: Column) -> Column:
    """Counts up to 32 alone, larger ones eight to a doubling."""
    return F.when(count <= 32, count).otherwise(32 + F.floor(8 * F.log2(count.cast("double") / 32))).cast("int")


def top_terms(audit: Audit, k: int) -> DataFrame:
    """lang, source, item, value, rank: the k terms of each group that stand out most, of those more probable there
    than in the language; equal values by term."""
    groups = few(audit.groups, MOST_BUCKETS)
    rows = audit.counts.join(groups, ["lang", "source"]).withColumn("bucket", bucket(F.col("count")))
    group = ["lang", "source"]
    size = rows.groupBy(*group, "bucket", "total", "kept", "lang_total").agg(F.max("count").alias("_most"), F.min("in_lang").alias("_least"), F.count("*").alias("n"))
    high, low = probability(F.col("_most"), F.col("total"), F.col("kept")), probability(F.col("_least"), F.col("lang_total"), F.col("kept"))
    bounds = cut(size.withColumn("_p", high).withColumn("_q", low).filter("_p > _q").select(*group, "bucket", "n", divergence(F.col("_p"), F.col("_q")).alias("bound")))
    best = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket")
    seen = F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = bounds.withColumn("first", seen < k)

    def evaluate(buckets: DataFrame) -> DataFrame:
        found = rows.join(few(buckets.select(*group, "bucket"), MOST_BUCKETS), [*group, "bucket"])
        found = found.withColumn("_p", probability(F.col("count"), F.col("total"), F.col("kept"))).withColumn("_q", probability(F.col("in_lang"), F.col("lang_total"), F.col("kept")))
        return found.filter("_p > _q").select(*group, F.col("term").alias("item"), divergence(F.col("_p"), F.col("_q")).alias("value"))

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    begun = cut(ranked(evaluate(bounds.filter("first"))))
    kth = begun.filter(F.col("rank") == k).select(*group, F.col("value").alias("_kth"))
    unseen = bounds.filter(~F.col("first")).join(few(kth, MOST_BUCKETS), group, "left").filter(F.col("_kth").isNull() | (F.col("bound") >= F.col("_kth")))
    return ranked(begun.drop("rank").unionByName(evaluate(unseen)))


def _exact(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """probability() of numpy's 64-bit numbers, by quotient and remainder, so that no product overflows."""
    whole, rest = np.divmod(count + 1, total + kept)
    if (total + kept).max(initial=0) < 1 << 33:
        return 1 + SCALE * whole + SCALE * rest // (total + kept)
    return 1 + SCALE * whole + np.array([SCALE * int(r) // int(t) for r, t in np.broadcast(rest, total + kept)], np.int64).reshape(rest.shape)


def source_pairs(audit: Audit, most_groups: int = MOST_GROUPS) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language, the most distant first."""
    widest = audit.groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    both = _in_arrays(audit) if widest <= most_groups and audit.groups.count() <= 8 * most_groups else _in_joins(audit)
    groups = few(audit.groups.select("lang", F.col("source").alias("item"), F.col("total").alias("_of")), MOST_BUCKETS)
    pairs = audit.groups.join(groups, "lang").filter("source <> item")
    # a count on one side against zero on the other, by histogram
    histogram = audit.counts.groupBy("lang", "source", "count").agg(F.count("*").alias("n"))
    sides = histogram.join(few(pairs, MOST_BUCKETS), ["lang", "source"])
    zero = F.lit(0).cast("bigint")
    p, p0, q0 = (probability(c, F.col(t), F.col("kept")) for c, t in ((F.col("count"), "total"), (zero, "total"), (zero, "_of")))
    one = sides.select("lang", "source", "item", (F.col("n") * (divergence(p, q0) - divergence(p0, q0))).alias("value"))
    other = sides.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("n") * (divergence(q0, p) - divergence(q0, p0))).alias("value"))
    none = pairs.select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("kept") * divergence(p0, q0)).otherwise(0).alias("value"))
    sums = none.unionByName(one).unionByName(other).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.withColumn("rank", F.row_number().over(order))


def _in_joins(audit: Audit) -> DataFrame:
    """What terms of both sources add over the two one-sided values, a row a term and pair."""
    rows = audit.counts.join(audit.groups, ["lang", "source"])
    a = rows.select("lang", "term", "source", "count", "total", "kept")
    b = rows.select("lang", "term", F.col("source").alias("item"), F.col("count").alias("_count"), F.col("total").alias("_of"))
    at = a.join(b, ["lang", "term"]).filter("source <> item")
    zero = F.lit(0).cast("bigint")
    p, p0 = (probability(c, F.col("total"), F.col("kept")) for c in (F.col("count"), zero))
    q, q0 = (probability(c, F.col("_of"), F.col("kept")) for c in (F.col("_count"), zero))
    return at.select("lang", "source", "item", (divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)).alias("value"))


def _in_arrays(audit: Audit) -> DataFrame:
    """The same, summed by a task over the postings it reads: a row for each pair and task."""
    of: dict[str, tuple[list[str], np.ndarray, int]] = {}
    for r in audit.groups.orderBy("lang", "source").collect():  # 8 MOST_GROUPS at most
        names, totals, _ = of.setdefault(r.lang, ([], [], 0))
        names.append(r.source), totals.append(r.total)
        of[r.lang] = (names, totals, r.kept)
    known = audit.groups.sparkSession.sparkContext.broadcast(of)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        place = {lang: {s: i for i, s in enumerate(names)} for lang, (names, _, _) in known.value.items()}
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            at = batch.column(1)
            ends, flat = at.offsets.to_numpy(), at.values
            sources, counts = flat.field(0).to_pylist(), flat.field(1).to_numpy()
            for lang in np.unique(langs.astype(str)).tolist():
                names, totals, kept = known.value[lang]
                total, into = np.array(totals, np.int64), sums.setdefault(lang, np.zeros((len(names), len(names)), np.int64))
                zero = _exact(np.zeros(len(names), np.int64), total, kept)
                for i in np.flatnonzero(langs == lang).tolist():
                    a, b = int(ends[i]), int(ends[i + 1])
                    who = np.array([place[lang][s] for s in sources[a:b]])
                    p, p0 = _exact(counts[a:b], total[who], kept), zero[who]
                    f = lambda x, y: (x[:, None] - y[None, :]) ** 2 // y[None, :]
                    into[np.ix_(who, who)] += f(p, p) - f(p, p0) - f(p0, p) + f(p0, p0)
        for lang, into in sums.items():
            names = known.value[lang][0]
            for i, source in enumerate(names):
                others = [j for j in range(len(names)) if j != i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(others), pa.string()), pa.array([source] * len(others), pa.string()), pa.array([names[j] for j in others], pa.string()), pa.array(into[i][others], pa.int64())],
                    ["lang", "source", "item", "value"],
                )

    return audit.postings.filter("term is not null and size(at) > 1").select("lang", "at").mapInArrow(add, "lang string, source string, item string, value bigint")


def audit_sources(docs: DataFrame, least_docs: int = 3, k: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank. Part `term`: the group's terms that stand out from the language, to rank
    k; part `pair`: every other source of the language.

    Null texts, langs and sources count as empty; a group without terms has no part `term`, and a language without
    kept terms has pairs of value 0. A text of any length is counted whole; repeated rows count as often as they
    come; equal values are ranked by the item's bytes. Only text, lang and source are looked at, of columns with one
    name the first. An empty table gives no rows."""
    audit = Audit(docs, least_docs)
    parts = [x.withColumn("part", F.lit(part)) for part, x in (("term", top_terms(audit, k)), ("pair", source_pairs(audit)))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), "rank")


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all languages, terms of three documents or more, 200 terms a group."""
    return audit_sources(read(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH docs AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
  words AS (SELECT no, lang, source, unnest(ts) AS term FROM docs),
  per_lang AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT no) >= 3),
  per_group AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN per_lang USING (lang, term) GROUP BY ALL),
  langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN per_lang USING (lang) GROUP BY ALL),
  groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN per_group USING (lang, source) GROUP BY ALL),
  of_lang AS (SELECT lang, term, 1 + (1000000000 * (n + 1)::HUGEINT) // (total + v) AS q FROM per_lang JOIN langs USING (lang)),
  every AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.total + v) AS p
    FROM groups g JOIN langs USING (lang) JOIN per_lang t ON t.lang = g.lang LEFT JOIN per_group c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM every JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q),
  added AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN added x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
  found AS (SELECT * FROM terms UNION ALL SELECT * FROM pairs)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 200"""
