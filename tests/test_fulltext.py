"""Stems, covers and the index of postings, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quoin.functions.stems import STOP, stem, tokens
from quoin.operators import fulltext, search, store

# Words and stems of the published vocabulary, in its order.
KNOWN = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistently consist consolation consol consolatory consolatori
consolidate consolid consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir constable constabl constancy constanc knackeries knackeri knavish knavish kneaded knead
knightly knight knives knive knotted knot generously generous general general communism communism arsenal arsenal hopping hop hoping hope skies sky dying die news news exceed exceed inning inning relational relat
conditional condit rational ration valency valenc digitizer digit conformably conform vilely vile analogously analog feudalism feudal decisiveness decis sensibility sensibl triplicate triplic formative format
electrical electr revival reviv airliner airlin adjustable adjust replacement replac adoption adopt communication communic activate activ homologous homolog probate probat rate rate cease ceas controlling control
says say by by ties tie cries cri gas gas this this kiwis kiwi gaps gap agreed agre luxuriated luxuri singly singl yes yes youth youth boyish boyish""".split()


def test_stems_of_known_words():
    assert {w: stem(w) for w in KNOWN[::2]} == dict(zip(KNOWN[::2], KNOWN[1::2], strict=True))


def vector(text):
    at = {}
    for i, w in enumerate(tokens(text), 1):
        if w not in STOP:
            at.setdefault(stem(w), []).append(i)
    return at


def plain_rank(text, query):
    """Every stretch of query words that satisfies the query and has none inside that does."""
    at = vector(text)
    terms = {t for all_ in query for t in all_}
    places = sorted((p, t) for t in terms for p in at.get(t, []))
    good = []
    for i in range(len(places)):
        for j in range(i, len(places)):
            have = {t for _, t in places[i : j + 1]}
            if any(set(all_) <= have for all_ in query):
                good.append((i, j))
                break
    small = [(i, j) for i, j in good if not any((a, b) != (i, j) and i <= a and b <= j for a, b in good)]
    return sum(0.1 / (1 + (places[j][0] - places[i][0]) - (j - i)) for i, j in small)


QUERIES = ["court", "court bail", "bail or court", "court appeal or bail judges or tax", "courts courting bail", "the of", "absent", "absent or court"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    words = ["court", "Courts", "bail", "appeal", "the", "judges", "tax", "other"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 2, 5, 9, 30]))) for _ in range(120)] + [None, "", "!?", "court " * 3000]
    frame = spark.createDataFrame([(i, i % 5, t) for i, t in enumerate(texts)], "id bigint, issue_id bigint, search_text string")
    return texts, fulltext.with_vectors(frame.repartition(3)).cache()


def best(texts, query, limit, keep=lambda i: True):
    scored = [(-round(plain_rank(t or "", query), 6), i) for i, t in enumerate(texts) if keep(i) and any(set(a) <= set(vector(t or "")) for a in query)]
    return [i for _, i in sorted(scored)[:limit]]


@pytest.mark.parametrize("text", QUERIES)
def test_covers_against_all_stretches(rows, text):
    texts, frame = rows
    texts = texts[:-1]  # the plain version is too slow for the long one
    query = fulltext.web_query(text)
    got = {r.id: r.score for r in frame.filter(F.col("id") < len(texts)).select("id", fulltext.cover_rank(F.col("tsv"), query).alias("score")).collect()}
    assert {i: pytest.approx(s) for i, s in got.items()} == {i: plain_rank(t or "", query) for i, t in enumerate(texts)}
    assert [r.id for r in fulltext.search(frame.filter(F.col("id") < len(texts)), query, 40).orderBy("rank").collect()] == best(texts, query, 40)


def test_queries_are_read():
    assert fulltext.web_query("Court's bail OR the appeals") == [["court", "bail"], ["appeal"]] and fulltext.any_of("bail bails of court") == [["bail"], ["court"]]
    assert fulltext.all_of("the") == [] == fulltext.any_of("") == fulltext.web_query("or or")


def test_index_answers_as_the_scan_and_reads_in_part(spark, rows, tmp_path):
    texts, frame = rows
    index = fulltext.Index(spark, f"file://{tmp_path}/postings", 16)
    index.replace(frame, frame.select("issue_id"))
    for text in QUERIES:
        query = fulltext.web_query(text)
        scan = [tuple(r) for r in fulltext.search(frame, query, 200).orderBy("rank").collect()]
        assert [tuple(r) for r in index.search(query, 200).orderBy("rank").collect()] == scan
        some = [tuple(r) for r in fulltext.search(frame, query, 200, F.col("issue_id").isin(1, 3)).orderBy("rank").collect()]
        assert [tuple(r) for r in index.search(query, 200, [1, 3]).orderBy("rank").collect()] == some
    one = index.postings([["court"]], [1])
    assert len(one.inputFiles()) > 16 and {f.split("issue_id=")[1].split("/")[0] for f in (r.f for r in one.select(F.input_file_name().alias("f")).collect())} == {"1"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "term" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_index_replaces_touched_issues_alone(spark, rows, tmp_path):
    texts, frame = rows
    index = fulltext.Index(spark, f"file://{tmp_path}/postings", 4)
    index.replace(frame, frame.select("issue_id"))
    new = fulltext.with_vectors(spark.createDataFrame([(1, 1, "zebra court"), (2, 2, "zebra")], "id bigint, issue_id bigint, search_text string"))
    index.replace(new, spark.createDataFrame([(1,), (4,)], "issue_id bigint"))  # 2 is not touched, 4 is emptied
    assert [r.id for r in index.search([["zebra"]]).collect()] == [1]
    query = [["court"]]
    assert sorted(r.id for r in index.search(query, 500).collect()) == sorted([*best(texts, query, 500, lambda i: i % 5 not in (1, 4)), 1])


def test_stored_vectors_follow_the_text(spark):
    from quoin import schemas

    none = spark.createDataFrame([], schemas.TABLES["extractions"])
    row = spark.createDataFrame([(7, "granted Bails")], "article_id bigint, search_text string")
    new = row.select("article_id", "search_text", *(F.lit(None).cast(none.schema[c].dataType).alias(c) for c in none.columns if c not in ("article_id", "search_text", "tsv", "embedding")))
    got = store.upsert_extractions(none, new)
    assert [(t.term, t.positions) for t in got.first().tsv] == [("bail", [2]), ("grant", [1])]
    cards = got.select(F.col("article_id").alias("id"), "tsv", "embedding", "search_text")
    assert [r.id for r in search.hybrid_search(cards, "who grants bail").collect()] == [7]
