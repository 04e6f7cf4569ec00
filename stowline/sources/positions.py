"""Late materialisation: values for the rows of wide Parquet files, found by file and row position.

A join would shuffle the wide rows. Here only keys and positions are joined; the
values are written in file and position order, and every scan task fetches those of
the rows it reads, which lie next to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline import settings
from stowline.sources.staging import most_rows, stage, staging_root

#: Rows of a file whose values a worker holds at once.
WINDOW_ROWS = 200_000
_VALUES = "_new"


def at_positions(files: DataFrame, values: DataFrame, key: str) -> DataFrame | None:
    """``files`` plus ``_new`` of ``values`` (``key``, ``_new``), without a shuffle of ``files``.

    None if ``files`` is not a plain scan of Parquet files, or the executors'
    Python workers cannot open the staged tables. ``values`` has unique keys.
    """
    try:
        places = files.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), key)
        wide = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return None
    spark = files.sparkSession
    if not _openable(staging_root(spark)):
        return None
    found = places.join(values.select(key, _VALUES), key)
    parts = max(1, (most_rows(values) or 0) // settings.PART_ROWS)
    bucket = F.pmod(F.xxhash64("_file"), F.lit(parts)).cast("int")
    table = stage(found.select(bucket.alias("bucket"), "_file", "_row", _VALUES).repartitionByRange(
        max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket", "_file", "_row").sortWithinPartitions(
        "bucket", "_file", "_row"), "positions", by=["bucket"])
    base = table.staged_path

    @F.pandas_udf("string")
    def fetch(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import pandas as pd

        held = _Held(base)
        for where, file, row in batches:
            out = pd.Series([None] * len(file), dtype=object)
            for (b, name), own in row.groupby([where, file], sort=False):
                out.loc[own.index] = held.values(int(b), name, own)
            yield out

    return wide.withColumn(_VALUES, fetch(bucket, "_file", "_row")).drop("_file", "_row")


def _openable(folder: str) -> bool:
    import pyarrow as pa

    from stowline.sources.stores import locate

    try:
        store, place = locate(folder)
        store.get_file_info(place)
        return True
    except (pa.ArrowException, ValueError, OSError):
        return False


class _Held:
    """The staged values of one window of one file's rows at a time."""

    def __init__(self, base: str):
        self.base, self.key, self.found = base, None, None

    def values(self, bucket: int, file: str, rows: pd.Series) -> list:
        low, high = int(rows.min()), int(rows.max())
        if self.key is None or self.key[0] != file or low < self.key[1] or high > self.key[2]:
            self.key = file, low, max(high, low + WINDOW_ROWS)
            self.found = self._read(bucket, *self.key)
        return rows.map(self.found).where(rows.isin(self.found.keys()), None).tolist()

    def _read(self, bucket: int, file: str, low: int, high: int) -> dict[int, str]:
        from pyarrow import dataset, fs

        from stowline.sources.stores import locate

        store, place = locate(f"{self.base}/bucket={bucket}")
        if store.get_file_info(place).type == fs.FileType.NotFound:
            return {}
        at = dataset.field("_row")
        table = dataset.dataset(place, filesystem=store, format="parquet").to_table(
            columns=["_row", _VALUES], filter=(dataset.field("_file") == file) & (at >= low) & (at <= high))
        return dict(zip(table.column("_row").to_pylist(), table.column(_VALUES).to_pylist(), strict=True))
