import os
import random
from glob import glob

from pyspark.sql import functions as F

from stowline import settings
from stowline.operators import ordinal
from stowline.operators.matching import keep_matching
from stowline.operators.ordinal import number_within, with_ordinal
from stowline.sources.staging import staging_root


def test_global_ordinal_counts_through_all_partitions(spark):
    values = list(range(5000))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    up = with_ordinal(df, ["v"], "n").collect()
    assert sorted(r.n for r in up) == list(range(1, 5001))
    assert all(r.n == r.v + 1 for r in up)
    down = with_ordinal(df, [F.desc("v")], "n").collect()
    assert all(r.n == 5000 - r.v for r in down)
    assert with_ordinal(df.filter("v < 0"), ["v"], "n").count() == 0


def test_groups_of_any_size_number_alike(spark, limits):
    draw = random.Random(4)
    rows = [("hot" if draw.random() < 0.4 else f"k{draw.randrange(60)}", i) for i in range(3000)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v long")

    def numbered():
        return {(r.k, r.v): (r.n, r.total) for r in
                number_within(df, ["k"], [F.desc("v")], "n", count_as="total").collect()}

    plain = numbered()
    limits(hot=40)
    assert numbered() == plain
    limits(hot=0)
    assert numbered() == plain
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert plain == {(k, v): (i, len(vs)) for k, vs in groups.items()
                     for i, v in enumerate(sorted(vs, reverse=True), 1)}


def test_a_hot_group_spreads_over_partitions(spark, limits):
    limits(hot=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = number_within(spark.range(40000).select(F.lit("one").alias("k"), "id"),
                                 ["k"], ["id"], "n")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r[0] for r in numbered.select(F.col("n") - F.col("id")).collect()} == {1}
    parts = glob(staging_root(spark).removeprefix("file:") + "/sorted-*/part-*")
    newest = max(parts, key=os.path.getmtime)
    assert len(glob(os.path.dirname(newest) + "/part-*")) == 2


def test_rows_of_unknown_number_are_sorted_in_parts_of_known_size(spark, limits, monkeypatch):
    limits(hot=100)
    monkeypatch.setattr(settings, "PART_ROWS", 1000)
    seen = []
    kept = ordinal.stage
    monkeypatch.setattr(ordinal, "stage", lambda df, label, **m: seen.append((label, df.rdd.getNumPartitions()))
                        or kept(df, label, **m))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = with_ordinal(spark.range(20_000).filter("id % 2 = 0"), [F.desc("id")], "n")
        assert numbered.agg(F.min("n"), F.max("n"), F.count("*")).first() == (1, 10_000, 10_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert dict(seen)["sorted"] == 10


def test_keep_matching_either_way(spark, limits):
    rows, keys = spark.range(100), spark.range(0, 200, 3)
    expected = sorted(range(0, 100, 3))
    assert sorted(r.id for r in keep_matching(rows, keys, ["id"]).collect()) == expected
    limits(broadcast=5)
    kept = keep_matching(rows, keys, ["id"])
    assert sorted(r.id for r in kept.collect()) == expected
    assert "ResolvedHint" not in kept._jdf.queryExecution().analyzed().toString()
