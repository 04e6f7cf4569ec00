"""Intermediate tables in the shared folder the cluster names.

A staged table cuts lineage, survives lost executors, and is read back column
by column. Its rows are counted while it is written, so later steps know an
upper bound without a pass of their own. ``drop_staged`` removes an
application's tables when its results have been written.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """Folder of this application's staged tables, under ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="stowline-")
        shared = _local_roots[app]
    return f"{shared.rstrip('/')}/stowline-{app}"


def stage(df: DataFrame, label: str, by: list[str] = (), **measures: Column) -> DataFrame:
    """Write ``df`` and read it back, taking ``measures`` (aggregates) on the way; ``by`` names folder columns."""
    path = f"{staging_root(df.sparkSession)}/{label}-{uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"),
               *[m.alias(n) for n, m in measures.items()]).write.partitionBy(*by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_measures = seen.get
    table.staged_path = path
    return table


def measures_of(table: DataFrame) -> dict[str, int]:
    """``rows`` and the further measures of a table as :func:`stage` returned it."""
    return table.staged_measures


def most_rows(table: DataFrame) -> int | None:
    """Exact row count of a staged table, None for any other DataFrame."""
    return vars(table).get("staged_measures", {}).get("rows")


def drop_staged(spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
