"""Documents as a data source: spans of laid-out text, read a range of pages at a time by a decoder.

A decoder is a module with `page_spans(content, wanted)`: the spans (rows of the schema but for `issue`) of the pages that
`wanted` lets through; no PDF library is assumed. A large file is several partitions: each decodes every n-th page, so
no file has to be opened to plan the scan. A filter on the page, or the option `lastPage`, reaches the decoder, and
partitions without wanted pages are not made.

    spark.dataSource.register(Documents)
    spark.read.format("documents").option("decoder", "my_decoder").load("hdfs:///issues")
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual

from quoin.schemas import SPANS
from quoin.sources.ledger import filesystem

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Pages(InputPartition):
    """Of a file the pages p with (p - 1) % of == number."""

    path: str
    number: int
    of: int


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SPANS

    def reader(self, schema) -> DataSourceReader:
        return Pushed(self.options) if self.options.get("pushdown") == "true" else Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.decoder = options["path"], options["decoder"]
        self.ending, self.split = options.get("ending", ""), int(options.get("splitBytes", 8 << 20))
        self.first, self.last = 1, int(options["lastPage"]) if "lastPage" in options else None

    def partitions(self) -> list[Pages]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = filesystem(self.folder)
        at = fs.get_file_info(root)
        found = [at] if at.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        out = []
        for file in sorted((f for f in found if f.type == FileType.File and f.base_name.endswith(self.ending)), key=lambda f: f.path):
            of = max(1, -(-file.size // self.split))
            wanted = range(of) if self.last is None or self.last - self.first + 1 >= of else sorted({(p - 1) % of for p in range(self.first, self.last + 1)})
            out += [Pages(file.path, n, of) for n in wanted]
        return out or [Pages("", 0, 1)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = filesystem(self.folder)
        with fs.open_input_file(partition.path) as f:
            content = f.read()
        wanted = lambda page: (page - 1) % partition.of == partition.number and self.first <= page and (self.last is None or page <= self.last)
        name = partition.path.rsplit("/", 1)[-1]
        columns = [c.split()[0] for c in SPANS.split(", ")]
        for span in importlib.import_module(self.decoder).page_spans(content, wanted):
            yield tuple((span | {"issue": name})[c] for c in columns)


class Pushed(Reader):
    """Takes comparisons of the page with a number from the query's filters; Spark keeps the others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (LessThanOrEqual, LessThan, EqualTo)) and f.attribute == ("page",):
                last = f.value - isinstance(f, LessThan)
                self.last = last if self.last is None else min(self.last, last)
                if isinstance(f, EqualTo):
                    self.first = max(self.first, f.value)
            else:
                yield f


def document_spans(spark: SparkSession, path: str, decoder: str, last_page: int | None = None, ending: str = "") -> DataFrame:
    """Spans of the documents below `path`. Filters on the page are pushed to the decoder where the session lets
    Python sources take them (spark.sql.python.filterPushdown.enabled)."""
    spark.dataSource.register(Documents)
    reader = spark.read.format("documents").option("decoder", decoder).option("ending", ending).option("pushdown", str(spark.conf.get(PUSHDOWN, "false")).lower())
    return (reader if last_page is None else reader.option("lastPage", last_page)).load(path)
