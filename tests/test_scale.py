"""Steps whose work or memory grew faster than their input."""

import random

from quoin.functions.similarity import token_set_ratio
from quoin.operators import dedup


def _stories(n, seed):
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "in", "ti", "ed", "nd", "ha", "É", "st"]
    text = lambda k: " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(k))
    return [(text(r.choice((1, 3, 12, 70))), text(r.choice((2, 20, 40)))) for _ in range(n)]


def test_alike_compares_few_pairs_one_by_one(monkeypatch):
    rows = _stories(250, 1)
    rows += [(h + " the", b[:-2]) for h, b in rows[:10]]
    for cut in (80, 60):
        p = dedup.Duplicates(headline=cut, body=cut)
        wanted = {(i, k) for i in range(len(rows)) for k in range(i) if all(token_set_ratio(rows[i][j], rows[k][j]) >= cut for j in (0, 1))}
        for first in (0, 100):
            compared = []
            monkeypatch.setattr(dedup, "token_set_ratio", lambda a, b, c: compared.append(0) or token_set_ratio(a, b, c))
            found = list(dedup.alike(rows, first, p))
            assert len(found) == len(set(found))
            assert set(found) == {(i, k) for i, k in wanted if not first or k < first <= i}
            assert len(compared) <= (500 if cut == 80 else 4000)
    assert len(wanted) > 10


def test_grouping_works_out_its_rows_once(spark):
    from pyspark.sql import functions as F

    from quoin.operators import search

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(20).select(F.lit("2024-01-01").cast("date").alias("issue_date"), F.col("id").alias("rank"), F.lit(1).alias("page_no"), F.concat(F.lit("story about number "), F.col("id").cast("string")).alias("headline"), "id")
    rows = rows.withColumn("body", counted(F.col("headline")))
    assert search.grouped(rows).count() >= 1
    assert seen.value == 20


def test_vectors_hold_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    from quoin.functions import stems

    texts = [None, "", "The licensed version of licences", *(f"word{i} and words" for i in range(400))]
    held = []
    plain = stems._vectors_of
    monkeypatch.setattr(stems, "_vectors_of", lambda some: held.append(len(some)) or plain(some))
    assert stems._vectors.func(pa.array(texts, pa.string())).to_pylist() == plain(texts).to_pylist()
    assert max(held) <= stems.TOGETHER and sum(held) == len(texts)


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    from quoin import views

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    before = spark.conf.get(views.BATCH)
    try:
        spark.conf.set(views.BATCH, views.DEFAULT_BATCH)
        views.read(spark, str(tmp_path), "t")
        assert int(spark.conf.get(views.BATCH)) <= 1000
        spark.conf.set(views.BATCH, "77")
        views.read(spark, str(tmp_path), "t")
        assert spark.conf.get(views.BATCH) == "77"
    finally:
        spark.conf.set(views.BATCH, before)


def test_groups_meet_leaders_alone(spark, monkeypatch):
    import pandas as pd

    from pyspark.sql import functions as F

    r = random.Random(5)
    names = [" ".join(r.choices(["ann", "bo", "cy", "dora"], k=2)) for _ in range(120)]
    rows = [(i + 1, n, "one and the same body") for i, n in enumerate(names)]
    stories = spark.createDataFrame(rows, "visit int, h string, b string").withColumn("issue_date", F.lit(None).cast("date"))
    p = dedup.Duplicates(headline=60, body=60, block=8)
    joined = {}
    for v, h, b in rows:
        for e, h2, b2 in rows[: v - 1]:
            if e not in joined and token_set_ratio(h, h2) >= 60 and token_set_ratio(b, b2) >= 60:
                joined[v] = e
                break
    met = []
    for name in ("similar_pairs", "similar_to"):
        plain = getattr(dedup, name)
        monkeypatch.setattr(dedup, name, lambda *a, plain=plain: met.append(plain(*a).persist()) or met[-1])
    got = {x.visit: x.leader for x in dedup.joined_leaders(stories, p).collect()}
    assert got == joined
    assert sum(m.count() for m in met) < 120 * 8  # all pairs that are alike are far more


def test_texts_give_few_stretches_to_look_up(spark):
    from pyspark.sql import functions as F

    from quoin.functions import text as T
    from quoin.operators import grounding

    seen = spark.sparkContext.accumulator(0)
    plain = grounding._begun

    def counted(marks):
        find = plain(marks).func

        @F.pandas_udf("array<struct<_size: int, _key: bigint>>")
        def f(texts):
            found = find(texts)
            seen.add(sum(map(len, found)))
            return found

        return f

    needle = "the quick brown fox jumps over the lazy dog and then over the other lazy dog once more"
    texts = [f"word{i} " * 40 + (needle if i % 10 == 0 else needle[:60]) for i in range(50)]
    docs, items = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(1, needle), (2, "é\u0301" * 30), (3, "")], "item_id long, needle string")
    grounding._begun = counted
    try:
        assert {(r.id, r.item_id) for r in grounding.holding(docs, items).collect()} == {(i, 1) for i in range(0, 50, 10)}
    finally:
        grounding._begun = plain
    assert seen.value == 5
    odd = ["A,b", "\0a\0", "É—x  y\n\n z", "हिन्दी, A।", "中 a", "İ", "", "\x01 a \u2028b"]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string")
    plainly = F.trim(F.regexp_replace(F.lower("t"), "[^0-9a-zऀ-ॿ]+", " "))
    assert df.filter(~T.norm(F.col("t"), unify=False).eqNullSafe(plainly)).count() == 0
    assert df.filter(~T.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_a_line_does_not_measure_its_whole_text(spark, tmp_path):
    """A page's height comes from its number of lines: found for each line, it took a text's length times its lines."""
    import contextlib
    import io
    import re

    from pyspark.sql import functions as F

    from quoin import views

    rows = [(1, "a\n" * 3000, "i"), (2, "", "i"), (3, None, "i"), (4, "\n", "i"), (5, "é\nb", "i")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    every = views.blocks(spark, str(tmp_path))
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        every.explain("formatted")
    carried = re.findall(r"posexplode\(.*?\), \[(.*?)\], false", plan.getvalue(), re.S)
    assert carried and all("leaf#" in c and "text#" not in c for c in carried)
    heights = {r.page: r.height for r in views.pages(spark, str(tmp_path)).collect()}
    assert heights == {1: 38400.0, 2: 100.0, 3: 100.0, 4: 100.0, 5: 100.0}
    got = {r.page: (r.n, r.y1) for r in every.groupBy("page").agg(F.count("*").alias("n"), F.max("y1").alias("y1")).collect()}
    assert {k: n for k, (n, _) in got.items()} == {1: 3001, 2: 1, 3: 1, 4: 2, 5: 2} and all(y < 0.97 * heights[k] for k, (_, y) in got.items())


def test_texts_are_cleaned_as_by_every_step(spark):
    """Steps that a text does not need are left out; ASCII texts don't go to Python."""
    from pyspark.sql import functions as F

    from quoin.functions import text as T

    blank = [chr(i) for i in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    odd = ["", "plain", "a-\nb-\nc", "co\u00ad \n op mid\u00addle", "ﬁne\x01\x7f\x80\ufffd\ue000\u0378é", "a\t\nb\tc\t\td", "हिन्दी  पाठ\nएक", "“x”\u200b y", "\U0001f600 \n😀", "É\x1b", "a\x00b", "\n\n x \n"]
    odd += [f"x{a}y{a}{b}z{b}\n{a}" for a in blank for b in blank] + ["see also Page 3, CONTİNUED ON PAGE 4 and details on pAgE 5x", "Contınued from page 12 more reports on A page 7"]
    marks, sh = "[\\p{Cc}\\p{Co}\\p{Cn}\\p{Cs}\\uFFFD\\u00AD&&[^\\n\\t]]", "\u00ad"
    t = F.regexp_replace(T.nfkc(F.regexp_replace(F.regexp_replace("t", f"(?U){sh}\\s*\\n\\s*", ""), sh, "-")), marks, "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?<=[a-z])-\n(?=[a-z])", ""), r"(?U)\s*\n\s*", " "), r"(?U)\s{2,}", " ")
    df = spark.createDataFrame([(x,) for x in [*odd, None]], "t string")
    wrong = df.select("t", T.clean_text(F.col("t")).alias("got"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "").alias("want")).filter("not (got <=> want)")
    assert wrong.collect() == []
    plain = df.select("t", T.without_references(F.col("t")).alias("got"), F.regexp_replace("t", T.CROSS_REFERENCE, " ").alias("want"))
    assert plain.filter("not (got <=> want)").count() == 0 and plain.filter("got <> t").count() == 2
    for pattern in (T.CONTINUED_FROM, T.CONTINUED_ON):
        found = df.select("t", T.marker(F.col("t"), pattern)["page"].alias("page"), F.regexp_extract("t", pattern, 1).alias("want")).filter("page is not null or want <> ''").collect()
        assert [(str(r.page) == r.want) for r in found] == [True]


def test_blocks_are_dealt_to_pages_once(spark, tmp_path):
    """A block's own size says whether it is a headline, so blocks are not dealt once more to leave the headlines out."""
    import contextlib
    import io

    from quoin import views
    from quoin.operators import layout

    spark.createDataFrame([(1, "a headline of it\n" * 30, "i")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        layout.articles(views.pages(spark, d), views.blocks(spark, d)).drop("section").explain("formatted")
    assert "Generate" in plan.getvalue() and "LeftAnti" not in plan.getvalue()  # no block is bold here


def test_the_report_writes_no_sections(spark, tmp_path, monkeypatch):
    """Stitching reads written articles; sections, which the report doesn't name, were looked up in all blocks for it."""
    import contextlib
    import io

    from quoin.operators import layout
    from quoin.queries import QUERIES

    lines = "\n".join(["a headline of it", *["some words of a body " * 2] * 40])
    spark.createDataFrame([(1, lines, "i")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, plain = [], layout.written

    def seen(rows):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            rows.explain("formatted")
        plans.append(plan.getvalue())
        return plain(rows)

    monkeypatch.setattr(layout, "written", seen)
    got = QUERIES["segment_report"](spark, str(tmp_path)).first()
    assert "posexplode(" in plans[0] and "upper(" not in plans[0]
    assert (got.issue, got.pages, got.scanned_pages, got.body_size, got.articles, got.incomplete) == ("i", 1, "", 9.0, got.articles, 0) and got.articles > 0


def test_classes_of_characters_leave_few_texts_to_compare(monkeypatch):
    r = random.Random(9)
    parts = ["th", "er", "on", "an", "re", "in", "ti", "ed", "nd", "ha", "st", "en", "of", "is", "wh", "ly"]
    text = lambda k: " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(k))
    rows = [(text(30), text(50)[:300]) for _ in range(400)]
    asked = []
    plain = dedup.Bag.maybe
    monkeypatch.setattr(dedup.Bag, "maybe", lambda self, i, k, cut: asked.append(i.size) or plain(self, i, k, cut))
    assert list(dedup.alike(rows, 0, dedup.Duplicates())) == []
    assert sum(asked) < 400  # of 79,800 pairs; common characters alone leave half


def test_bounds_lose_no_pair_near_the_cut():
    r = random.Random(4)
    letters = "eeeeennnttaaiosrhldcu" + "éßñxqzöя中"
    word = lambda: "".join(r.choices(letters, k=r.randint(1, 9)))

    def changed(text, share):
        out = list(text)
        for _ in range(int(len(out) * share)):
            i = r.randrange(len(out))
            out[i] = r.choice(letters) if r.random() < 0.7 else ""
        return "".join(out)

    rows = []
    for k in (2, 5, 12, 30, 60, 110):
        for _ in range(3):
            head, body = " ".join(word() for _ in range(k)), " ".join(word() for _ in range(60))[:300]
            rows += [(head, body), *((changed(head, x), changed(body, y)) for x in (0.05, 0.1, 0.14) for y in (0, 0.09, 0.12))]
    rows += [("и" * 200 + " é", "a" * 290 + " b c"), ("и" * 190 + " ß", "a" * 280 + " c d"), ("one", "one two"), ("one", "two one three")]
    values = [[token_set_ratio(a[j], b[j]) for j in (0, 1)] for i, a in enumerate(rows) for b in rows[:i]]
    assert sum(75 < min(v) < 85 for v in values) > 150
    for cut in (80, 60):
        wanted = {(i, k) for i in range(len(rows)) for k in range(i) if min(values[i * (i - 1) // 2 + k]) >= cut}
        for first in (0, 70):
            found = list(dedup.alike(rows, first, dedup.Duplicates(headline=cut, body=cut)))
            assert len(found) == len(set(found))
            assert set(found) == {(i, k) for i, k in wanted if not first or k < first <= i}
