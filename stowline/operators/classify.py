"""Category by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.settings import EXTENSIONS, OTHER


def category_table(spark: SparkSession) -> DataFrame:
    """(extension, category), one row per known extension."""
    rows = [f"('{e}', '{c}')" for c, known in EXTENSIONS.items() for e in known]
    return spark.sql(f"select * from values {', '.join(rows)} as t(extension, category)")


def with_category(files: DataFrame) -> DataFrame:
    """``files`` plus ``category`` from ``extension``; the table is fixed, so broadcast."""
    table = F.broadcast(category_table(files.sparkSession))
    return (files.join(table, "extension", "left")
            .withColumn("category", F.coalesce("category", F.lit(OTHER))))
