"""Compare every query with its SQL: ``python -m workload.check [folder] [names...]``."""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

from workload.oracle import ORACLE
from workload.queries import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN",
         "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def compare(spark: SparkSession, duck: duckdb.DuckDBPyConnection, folder: str, name: str) -> str:
    """Empty when columns, types and rows are equal, else what differs."""
    result = QUERIES[name](spark, folder)
    expected = duck.execute(ORACLE[name])
    columns = {c[0]: str(c[1]) for c in expected.description}
    if columns != {c: TYPES[t] for c, t in result.dtypes}:
        return f"columns {result.dtypes} differ from {columns}"
    places = [list(columns).index(c) for c in result.columns]
    wanted = sorted(repr(tuple(r[p] for p in places)) for r in expected.fetchall())
    got = sorted(repr(tuple(r)) for r in result.collect())
    if got == wanted:
        return ""
    return (f"{len(got)} rows for {len(wanted)}; only here {sorted(set(got) - set(wanted))[:2]}; "
            f"only there {sorted(set(wanted) - set(got))[:2]}")


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    from stowline.session import build_session
    from stowline.sources.staging import drop_staged

    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="stowline-")})
    spark.sparkContext.setLogLevel("ERROR")
    duck, bad = connect(folder), 0
    for name in names or QUERIES:
        start = time.perf_counter()
        difference = compare(spark, duck, folder, name)
        bad += bool(difference)
        print(f"{name:24s} {time.perf_counter() - start:6.2f}s {difference or 'equal'}", flush=True)
    drop_staged(spark)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
