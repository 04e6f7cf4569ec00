import pytest
from pyspark.sql import functions as F

from stowline.operators.moves import apply_moves
from stowline.sources import positions


@pytest.fixture
def lake(spark, tmp_path):
    """A scan of several Parquet files with contents, some paths of the third file odd."""
    path = str(tmp_path / "lake é 100%")
    spark.range(3000).select(
        F.concat(F.lit("/lake/in/"), "id").alias("path"), F.concat(F.lit("in/"), "id").alias("rel_path"),
        F.col("id").alias("size"), F.repeat(F.lit("x"), F.pmod("id", F.lit(50)).cast("int")).alias("content"),
    ).repartition(4).write.option("parquet.block.size", 10_000).parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def moved(spark):
    return spark.range(0, 4000, 2).select(
        F.concat(F.lit("/lake/in/"), "id").alias("source_path"),
        F.when(F.col("id") % 10 > 0, F.concat(F.lit("/lake/out/"), "id", F.lit(".TXT"))).alias("final_path"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("window", [200_000, 7])
def test_contents_are_in_no_exchange(lake, moved, limits, monkeypatch, window):
    monkeypatch.setattr(positions, "WINDOW_ROWS", window)
    joined = apply_moves(lake, moved, "/lake")  # by broadcast
    limits(broadcast=10)
    late = apply_moves(lake, moved, "/lake")
    assert late.schema == joined.schema
    assert sorted(late.collect()) == sorted(joined.collect())
    assert late.filter("path like '%.TXT' and extension = 'txt' and rel_path like 'out/%'").count() == 1200
    plan = plan_of(late)
    assert "Exchange" not in plan and "Join" not in plan
    assert "_metadata" in plan or "file_path" in plan


def test_other_tables_are_joined(lake, moved, limits):
    limits(broadcast=10)
    twice = lake.union(lake.limit(0))
    assert sorted(apply_moves(twice, moved, "/lake").collect()) == sorted(apply_moves(lake, moved, "/lake").collect())


def test_no_moves_and_no_files(lake, moved, limits):
    limits(broadcast=0)
    assert apply_moves(lake, moved.limit(0)).select("path").exceptAll(lake.select("path")).isEmpty()
    assert apply_moves(lake.limit(0), moved).isEmpty()


def test_unreadable_staging_falls_back_to_a_join(lake, moved, limits, monkeypatch):
    limits(broadcast=10)
    late = sorted(apply_moves(lake, moved).collect())
    monkeypatch.setattr(positions, "_openable", lambda folder: False)
    assert sorted(apply_moves(lake, moved).collect()) == late
