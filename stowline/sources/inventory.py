"""Inventories: one row per file, read from a manifest table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.functions.names import base_name, extension, scan_key


def read_inventory(spark: SparkSession, path: str, columns: dict[str, Column | str],
                   format: str = "parquet", **options: str) -> DataFrame:
    """A manifest as an inventory.

    ``columns`` maps inventory columns (path, rel_path, size, modified, content)
    to manifest columns or expressions; only those are read.
    """
    table = spark.read.format(format).options(**options).load(path)
    return table.select(*[F.expr(c).alias(n) if isinstance(c, str) else c.alias(n)
                          for n, c in columns.items()])


def file_record(files: DataFrame) -> DataFrame:
    """``name`` from ``rel_path``, ``extension`` from ``name``."""
    name = base_name(F.col("rel_path"))
    return files.withColumns({"name": name, "extension": extension(name)})


def one_row_per_path(files: DataFrame) -> DataFrame:
    """Of rows that share a path (a file and links to it), the first in scan order.

    For metadata, not for inventories that carry contents.
    """
    rest = [c for c in files.columns if c != "path"]
    first = F.min_by(F.struct(*rest), F.struct(scan_key(F.col("rel_path")), F.col("name")))
    return files.groupBy("path").agg(first.alias("_first")).select("path", "_first.*")
