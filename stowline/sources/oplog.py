"""The append-only operation log.

A log is a folder of Parquet files. Every append owns a folder in it,
``append-<number>``, and a small file ``_appends/<number>`` that reserves the number and
a range of ids before anything is written, and names the batch. Reservations are
made by exclusive creation, so of two writers one takes the next number.
An append that is repeated finds its reservation: if it was finished nothing
happens, else it is written again in the same place with the same ids. The
reservation also tells the append's last success, so the newest batch is found
without a scan of the log. Files that lie in the folder itself came before
all appends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.functions.times import utc_now
from stowline.operators.ordinal import with_ordinal
from stowline.settings import OPERATION_TYPES, RECENT_OPERATIONS, STATUSES
from stowline.sources.staging import measures_of, most_rows, stage

SCHEMA = ("id bigint, batch_id string, operation_type string, source_path string, "
          "destination_path string, timestamp timestamp_ntz, status string, error_message string")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def new_batch_id() -> str:
    return uuid4().hex[:16]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def normalise(operations: DataFrame, batch_id: str | None = None,
              timestamp: Column | None = None) -> DataFrame:
    """Upper-case type and status, one batch id for rows without, a UTC time.

    A type or status outside its domain fails the job.
    """

    def domain(column: str, values: list[str]) -> Column:
        text = F.upper(column)
        return F.when(text.isin(values), text).otherwise(F.raise_error(
            F.concat(F.lit(f"Invalid {column} "), F.coalesce(F.col(column), F.lit("null")))))

    if "status" not in operations.columns:
        operations = operations.withColumn("status", F.lit("SUCCESS"))
    if "error_message" not in operations.columns:
        operations = operations.withColumn("error_message", F.lit(None).cast("string"))
    given = F.nullif(F.col("batch_id"), F.lit("")) if "batch_id" in operations.columns else F.lit(None)
    if "timestamp" not in operations.columns:
        operations = operations.withColumn(
            "timestamp", utc_now() if timestamp is None else timestamp)
    return operations.withColumns({
        "operation_type": domain("operation_type", OPERATION_TYPES),
        "status": domain("status", STATUSES),
        "batch_id": F.coalesce(given, F.lit(batch_id or new_batch_id())),
    })


def append(spark: SparkSession, path: str, operations: DataFrame, order: list[str],
           batch_id: str | None = None, timestamp: Column | None = None) -> None:
    """Add operations in ``order`` with ids after the log's highest.

    ``batch_id`` names the append: to append the same batch again, after a
    failure or by mistake, adds nothing twice. Rows are written sorted by id, so
    reads by id or batch skip row groups. Needs a store whose exclusive creation of
    a file is atomic, if there are several writers.
    """
    batch_id = batch_id or new_batch_id()
    known = _reservations(spark, path)
    mine = next((r for r in known if r["batch"] == batch_id), None)
    if mine is not None and _exists(spark, f"{_folder(path, mine)}/_SUCCESS"):
        return
    rows = with_ordinal(normalise(operations, batch_id, timestamp), order, "_n")
    succeeded = F.when(F.col("status") == "SUCCESS", F.col("_n"))
    rows = stage(rows, "operations", last_success=F.max(succeeded))
    if mine is None:
        mine = _reserve(spark, path, batch_id, most_rows(rows), measures_of(rows)["last_success"])
    elif mine["rows"] != most_rows(rows):
        raise ValueError(f"batch {batch_id} was begun with {mine['rows']} operations, not {most_rows(rows)}")
    rows.withColumn("id", F.col("_n") + (mine["first"] - 1)).select(*COLUMNS).write.mode("overwrite").parquet(
        _folder(path, mine))


def _folder(path: str, reservation: dict) -> str:
    return f"{path}/append-{reservation['number']:09d}"


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    store, place = _hadoop(spark, path)
    return store.exists(place)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the appends, newest first."""
    store, place = _hadoop(spark, f"{path}/_appends")
    if not store.exists(place):
        return []
    return sorted((int(f.getPath().getName()) for f in store.listStatus(place)
                   if f.getPath().getName().isdigit()), reverse=True)


def _reservation(spark: SparkSession, path: str, number: int) -> dict:
    store, place = _hadoop(spark, f"{path}/_appends/{number:09d}")
    stream = store.open(place)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return {"number": number, **json.loads(text)}


def _reservations(spark: SparkSession, path: str) -> Iterator[dict]:
    """The reservations, newest first, each read when it is asked for."""
    return (_reservation(spark, path, number) for number in _numbers(spark, path))


def _reserve(spark: SparkSession, path: str, batch_id: str, rows: int, last_success: int | None) -> dict:
    """The next number and id range that no other append has taken."""
    while True:
        newest = next(_reservations(spark, path), None)
        if newest is None:
            number, first = 1, (read_log(spark, path).agg(F.max("id")).first()[0] or 0) + 1
        else:
            number, first = newest["number"] + 1, newest["first"] + newest["rows"]
        mine = {"batch": batch_id, "first": first, "rows": rows,
                "last_success": None if last_success is None else first - 1 + last_success}
        if _create(spark, f"{path}/_appends/{number:09d}", json.dumps(mine)):
            return {"number": number, **mine}


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file was created; False if there is one."""
    store, place = _hadoop(spark, path)
    try:
        stream = store.create(place, False)
    except Py4JJavaError:
        if store.exists(place):
            return False
        raise
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    return True


def newest_success(spark: SparkSession, path: str) -> DataFrame:
    """The part of the log that has its last success: the files of one append, or all if no append had one."""
    for reservation in _reservations(spark, path):
        if reservation["last_success"] is not None and _exists(spark, f"{_folder(path, reservation)}/_SUCCESS"):
            return spark.read.schema(SCHEMA).parquet(_folder(path, reservation))
    return read_log(spark, path)


def create(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(path)


def recent(log: DataFrame, limit: int = RECENT_OPERATIONS) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(limit)


def latest_batch(log: DataFrame) -> DataFrame:
    """One row with the batch of the last successful operation of any type, or null."""
    return log.filter("status = 'SUCCESS'").agg(F.max_by("batch_id", "id").alias("batch_id"))


def latest_batch_id(log: DataFrame) -> str | None:
    return latest_batch(log).first()[0]


def batch_operations(log: DataFrame, batch_id: str | None) -> DataFrame:
    """A literal comparison, so that it reaches the scan."""
    return log.filter(F.col("batch_id") == F.lit(batch_id).cast("string"))
