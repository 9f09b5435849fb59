import random

import pytest

from quoin.functions import similarity
from quoin.queries import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """Writes documents, with the other tables that queries read, and gives their folder."""

    def write(texts, benchmark=()):
        rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
        spark.createDataFrame(list(benchmark), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_first_lines_are_read_whole(spark, tables):
    start = "plain words " * 12  # over 120 characters
    d = tables([f"{start}Supreme Court grants bail", f"{start}other end, licensed\nThe same body.", f"{start}{'quite different things ' * 8}\nThe same body."])
    clean = {r.id: r.clean for r in QUERIES["clean_text"](spark, d).collect()}
    assert clean[0].endswith(f"{start}Supreme Court grants bail") and clean[1].endswith("other end, licensed The same body.")
    passed = {r.id: r.hits for r in QUERIES["prefilter_defaults"](spark, d).collect()}
    assert r"\bbail\b" in passed[0] and passed[1] == ""
    assert [r.id for r in QUERIES["term_rank_stemmed"](spark, d).collect()] == [1]
    assert {r.id for r in QUERIES["dedup_fuzzy"](spark, d).collect()} == {0, 1, 2}


def test_short_passages_are_found(spark, tables):
    items = ["lone", "two words", "of three words", "ends in four wor", "this one has five words"]
    d = tables(["x\nAlone, two words; OF three words!", "x\nIt bends in four words. And this one has five wordsmiths.", "x\nnothing"], [(i, t) for i, t in enumerate(items)])
    got = {(r.id, r.item_id) for r in QUERIES["grounding_exact"](spark, d).collect()}
    assert got == {(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)}


def test_similarity_and_stitch_take_whole_texts(spark, tables):
    filler = "other things stand here " * 30
    last = "the court upholds privacy today"
    d = tables([f"{last}\n{filler}{last}", f"{filler}{last}\n{last}"])
    assert all((r.token_set, r.part) == (100.0, 100.0) for r in QUERIES["similarity"](spark, d).collect())
    assert {r.head: r.chars for r in QUERIES["stitch"](spark, d).collect()} == {0: len(filler + last) + 1 + len(last)}  # 1 goes on from 0


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "ab😀 é"])
def test_best_window_is_the_best_of_all(letters):
    rng = random.Random(5)
    for _ in range(60):
        a, b = sorted(("".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(2)), key=len)
        n = len(a)
        stretches = (b[max(0, i) : i + n] for i in range(1 - n, len(b)))
        assert similarity._best_window(a, b) == max(similarity.ratio(a, w) for w in stretches)


def test_printed_dates_are_detected(spark, tables):
    d = tables(["CHENNAI, FRIDAY, NOVEMBER 8, 2019\nOther text.", f"{'long line ' * 20}Monday March 2, 2020", "A title\nof Sunday, June 7, 2020", "No date"])
    got = {r.id: str(r.detected) for r in QUERIES["detect_date"](spark, d).collect()}
    assert got == {0: "2019-11-08", 1: "2020-03-02", 2: "2020-06-07", 3: "2024-04-03"}


def test_every_line_lies_between_the_bands(spark, tables):
    from quoin import views
    from quoin.operators import layout

    d = tables(["one line", "first\n" + "line\n" * 500 + "last", "", "a\nb"])
    every = views.blocks(spark, d)
    assert every.count() == 1 + 502 + 1 + 2 == layout.body_bands(views.pages(spark, d), every).count()
