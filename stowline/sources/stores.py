"""Files in mounted folders and object stores, opened by the executors' Python workers."""

from __future__ import annotations

import re
from functools import lru_cache

from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowline import settings
from stowline.sources.staging import stage

# Other names of the same kinds of store.
SAME_STORE = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
#: What opening a file costs, in bytes read.
OPEN_BYTES = 4 << 20

_URI = re.compile("([a-zA-Z][a-zA-Z0-9+.-]*):(//[^/]*)?(/.*)?", re.DOTALL)


def split_uri(path: str) -> tuple[str, str, str]:
    """(scheme, bucket or host, key) of a path; a path without a scheme is a mounted ``file``.

    The key is not decoded: ``%``, blanks and any other characters stand for themselves.
    """
    parts = _URI.fullmatch(path)
    if not parts or path.startswith("/"):
        return "file", "", path
    scheme, bucket, key = parts[1].lower(), (parts[2] or "//")[2:], parts[3] or ""
    return SAME_STORE.get(scheme, scheme), bucket, key


@lru_cache(maxsize=64)
def _store(scheme: str, bucket: str) -> tuple[fs.FileSystem, str]:
    """The file system of a bucket and where the bucket lies in it; one for each worker."""
    if scheme == "file":
        return fs.LocalFileSystem(), ""
    store, root = fs.FileSystem.from_uri(f"{scheme}://{bucket}/")
    return store, root.rstrip("/")


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that has ``path``, and its place there.

    ValueError, an Arrow error or OSError if there is no such kind of store.
    """
    scheme, bucket, key = split_uri(path)
    store, root = _store(scheme, bucket)
    return store, root + key


def deal_by_bytes(files: DataFrame, size: str = "size") -> DataFrame:
    """``files`` (narrow: paths and sizes) dealt into reading tasks of nearly equal bytes.

    The files form one line, whose running total of bytes (with ``OPEN_BYTES``
    for each file) is cut into equal lengths. Parts of the line are counted where
    they lie, so nothing but the part totals (one row each) is in one place. No
    file is split, so a task has at most its share and one file more.
    """
    spark = files.sparkSession
    weight = F.coalesce(F.col(size), F.lit(0)) + OPEN_BYTES
    placed = stage(files.withColumns({"_part": F.spark_partition_id(), "_weight": weight}), "dealt", all=F.sum("_weight"))
    total = placed.staged_measures["all"] or 0
    tasks = max(1, min(settings.reading_tasks(spark), placed.staged_measures["rows"]), total // settings.READ_BYTES)
    share = max(1, -(-total // tasks))
    before = (placed.groupBy("_part").agg(F.sum("_weight").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))
    own = F.sum("_weight").over(Window.partitionBy("_part").orderBy(F.xxhash64("path"), "path").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    middle = F.col("_before") + F.col("_own") - F.floor(F.col("_weight") / 2).cast("long")
    line = placed.withColumn("_own", own).join(F.broadcast(before), "_part")
    return line.withColumn("_task", F.least(F.floor(middle / share), F.lit(tasks - 1)).cast("int")).repartitionById(
        tasks, "_task").select(*files.columns)
