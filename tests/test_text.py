import datetime

from hypothesis import example, given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.functions.similarity import lcs, partial_ratio, ratio, token_set_ratio


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(column).first()[0]


def test_clean_text(spark):
    cases = {
        "eﬀ\x00ect": "effect",
        "co­\n  op": "coop",
        "Ex­officers": "Ex-officers",
        "a�b": "ab",
        "line-\nbreak two\n\nthree   four\xa0five ": "linebreak two three four five",
        "a-\nb-\nc": "abc",
        "A-\nB": "A- B",
        "": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "raw string, clean string")
    for r in rows.withColumn("got", T.clean_text(F.col("raw"))).collect():
        assert r.got == r.clean, r.raw


def test_norm_and_hash(spark):
    assert one(spark, T.norm(F.col("x")), x="“Straße” — Nº 5, हिन्दी!") == "stra e no 5 हिन्दी"
    assert one(spark, T.content_hash(F.col("a"), F.col("b")), a="h", b=None) == __import__("hashlib").sha1(b"h|").hexdigest()


def test_markers(spark):
    page, rest = T.pop_marker(F.col("x"), T.CONTINUED_ON)
    row = spark.createDataFrame([("One (two) CONTINUED ON A PAGE 12 three",), ("nothing",), (None,)], "x string").select(page.alias("p"), rest.alias("r")).collect()
    assert [tuple(r) for r in row] == [(12, "One (two)   three"), (None, "nothing"), (None, None)]


def test_issue_date(spark):
    date = T.issue_date(F.col("a"), F.col("b"), F.col("c"))
    assert one(spark, date, a="City Friday, November 8, 2019 x", b="", c="x") == datetime.date(2019, 11, 8)
    assert one(spark, date, a="Monday, November 31, 2019", b="x", c="p_20240229.pdf") == datetime.date(2024, 2, 29)
    assert one(spark, date, a="", b="", c="p_2023-02-29.pdf") is None


def test_numbers(spark):
    assert sorted(one(spark, T.numbers(F.col("x")), x="1,200 of 5. and 5 or 3.50")) == ["1200", "3.50", "5"]


def lcs_plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.text("abcd", max_size=40), st.text("abcd", max_size=40))
def test_lcs(a, b):
    assert lcs(a, b) == lcs_plain(a, b)


@given(st.text("ab ", max_size=30), st.text("ab ", max_size=30))
@example("b aaaaab", "aa aa ab b")  # 80 exactly
def test_token_set_ratio_is_best_of_three(a, b):
    x, y = set(a.split()), set(b.split())
    got = token_set_ratio(a, b)
    if not x or not y:
        assert got == 0
        return
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    joined = [f"{both} {r}".strip() for r in (left, right)]
    plain = 100.0 if x & y and (x <= y or y <= x) else max([ratio(*joined)] + ([ratio(both, j) for j in joined] if both else []))
    assert abs(got - plain) < 1e-9
    assert (token_set_ratio(a, b, 80) >= 80) == (plain >= 80)


@given(st.text("abc", min_size=1, max_size=8), st.text("abc", max_size=25))
def test_partial_ratio(a, b):
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    plain = max((ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b))), default=0.0) if n else (0.0 if b else 100.0)
    assert abs(partial_ratio(a, b) - plain) < 1e-9


def test_similarity_cuts():
    assert token_set_ratio("SC upholds privacy right", "privacy right SC upholds again") == 100
    assert token_set_ratio("rain in the hills", "budget passed today") < 60
    assert partial_ratio("article 22", "under article 21 of the law") == 90
