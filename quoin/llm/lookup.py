"""Written tables that tasks read by key, without a shuffle of what they look up for.

Rows go to folders by key modulo a number of files, sorted by key in small row groups, so a task finds a key's rows
by the folder's name and the row groups' statistics. Nothing about single keys reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.common import filesystem, shared_dir

ROW_GROUP = {"parquet.block.size": str(1 << 20), "parquet.block.size.row.check.min": "1"}


class Lookup:
    """Rows with a column `key` (a long), in `files` folders."""

    def __init__(self, rows: DataFrame, files: int):
        self.folder, self.files = f"{shared_dir(rows.sparkSession)}/lookup", files
        dealt = rows.withColumn("no", F.pmod("key", F.lit(files)).cast("int")).repartition(files, "no").sortWithinPartitions("no", "key")
        dealt.write.options(**ROW_GROUP).partitionBy("no").parquet(self.folder)

    def rows(self, key: int, columns: list[str]) -> Iterator[dict]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = filesystem(self.folder)
        for info in system.get_file_info(fs.FileSelector(f"{root}/no={key % self.files}", allow_not_found=True)):
            if not info.base_name.endswith(".parquet"):
                continue
            with system.open_input_file(info.path) as raw:
                file = pq.ParquetFile(raw)
                at = file.schema_arrow.get_field_index("key")
                for g in range(file.num_row_groups):
                    known = file.metadata.row_group(g).column(at).statistics
                    if known is None or not known.has_min_max or known.min <= key <= known.max:
                        for row in file.read_row_group(g, ["key", *columns]).to_pylist():
                            if row["key"] == key:
                                yield row


class Rows:
    """A set of numbers that monotonically_increasing_id gave: by their partition, its rows' places. A partition's
    places are as many as its rows, which the reader's split size bounds."""

    def __init__(self, numbers: DataFrame):
        number = F.col(numbers.columns[0])
        places = numbers.select(F.shiftright(number, 33).alias("key"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
        files = int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.table = Lookup(places.groupBy("key").agg(F.array_sort(F.collect_list("place")).alias("places")), files)

    def keep(self, df: DataFrame, number: str) -> DataFrame:
        """The rows whose number is in the set."""
        return df.filter(self._known(F.col(number)))

    def drop(self, df: DataFrame, number: str) -> DataFrame:
        """The rows whose number is not in the set."""
        return df.filter(~self._known(F.col(number)))

    def _known(self, number: Column) -> Column:
        table, held = self.table, {}

        def places(part: int) -> np.ndarray:
            if part not in held:
                held.clear()
                held[part] = np.array([p for r in table.rows(part, ["places"]) for p in r["places"]], np.int64)
            return held[part]

        @F.arrow_udf("boolean")
        def known(numbers: pa.Array) -> pa.Array:
            n = numbers.to_numpy()
            part, out = n >> 33, np.zeros(n.size, bool)
            for p in np.unique(part).tolist():
                mine = part == p
                out[mine] = np.isin(n[mine] & ((1 << 33) - 1), places(p), assume_unique=True)
            return pa.array(out)

        return known(number)
