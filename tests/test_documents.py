"""Documents read by ranges of pages."""

import json

from pyspark.sql import functions as F

from quoin.operators import layout
from quoin.sources.documents import PUSHDOWN, Pages, Pushed, Reader, document_spans


def write(folder):
    (folder / "sub").mkdir()
    every = []
    for name, pages in (("a.json", 7), ("sub/b.json", 1), ("c.json", 23)):
        lines = [[f"{name} {p} {n}" for n in range(p % 3 + 1)] for p in range(1, pages + 1)]
        (folder / name).write_text(json.dumps(lines))
        every += [(name.split("/")[-1], p, t) for p, page in enumerate(lines, 1) for t in page]
    (folder / "note.txt").write_text("no document")
    return sorted(every)


def found(df):
    return sorted((r.issue, r.page, r.text) for r in df.collect())


def test_pages_of_documents(spark, tmp_path):
    every = write(tmp_path)
    spans = document_spans(spark, f"file://{tmp_path}", "paged_decoder", ending=".json")
    assert found(spans) == every and layout.blocks(spans).count() == len(every)
    assert found(document_spans(spark, str(tmp_path), "paged_decoder", 2, ".json")) == [x for x in every if x[1] <= 2]
    assert found(document_spans(spark, f"{tmp_path}/a.json", "paged_decoder")) == [x for x in every if x[0] == "a.json"]
    none = tmp_path / "none"
    none.mkdir()
    assert document_spans(spark, str(none), "paged_decoder").count() == 0


def test_page_filters_reach_the_decoder(spark, tmp_path):
    every = write(tmp_path)
    spark.conf.set(PUSHDOWN, "true")
    try:
        spans = document_spans(spark, str(tmp_path), "paged_decoder", ending=".json")
        assert found(spans.filter("page <= 2")) == [x for x in every if x[1] <= 2]
        assert found(spans.filter((F.col("page") == 3) & F.col("text").startswith("c"))) == [x for x in every if x[1] == 3 and x[0] == "c.json"]
        assert found(spans.filter("page < 1")) == []
    finally:
        spark.conf.unset(PUSHDOWN)


def test_partitions_are_pages(tmp_path):
    write(tmp_path)
    options = {"path": str(tmp_path), "decoder": "paged_decoder", "ending": "c.json", "splitBytes": "100"}
    every = Reader(options).partitions()
    assert len(every) > 5 and len({(p.number, p.of) for p in every}) == len(every)
    few = Reader(options | {"lastPage": "2"})
    assert [p.number for p in few.partitions()] == [0, 1]
    texts = [r for p in every for r in Reader(options).read(p)]
    assert len(texts) == len({r[5] for r in texts}) == sum(p % 3 + 1 for p in range(1, 24))
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    pushed = Pushed(options)
    left = list(pushed.pushFilters([LessThan(("page",), 5), EqualTo(("page",), 3), GreaterThan(("page",), 1), EqualTo(("line",), 1)]))
    assert (pushed.first, pushed.last) == (3, 3) and len(left) == 2 and [p.number for p in pushed.partitions()] == [2] and isinstance(pushed.partitions()[0], Pages)
