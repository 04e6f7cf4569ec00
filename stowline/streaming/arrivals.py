"""The stateless steps on a stream: scope, file record, category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowline.operators.classify import with_category
from stowline.operators.scope import in_scope
from stowline.sources.inventory import file_record


def classify_arrivals(spark: SparkSession, folder: str, schema: str, **scope) -> DataFrame:
    """Parquet manifests dropped into ``folder``, scoped and classified as they come."""
    arrivals = spark.readStream.schema(schema).parquet(folder)
    return with_category(file_record(in_scope(arrivals, **scope)))
