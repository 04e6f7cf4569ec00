import pytest
from pyspark.sql import functions as F

from stowline.operators.bloom import blocks_for, bloom_blocks, keep_possible


def id_hash():
    return F.xxhash64("id")



@pytest.fixture
def blocks(spark):
    def most(n):
        spark.conf.set("spark.stowline.bloomBlocks", str(n))

    yield most
    spark.conf.unset("spark.stowline.bloomBlocks")


def test_holds_every_key_and_few_strangers(spark):
    n = blocks_for(spark, 10_000)
    keys = spark.range(10_000)
    found = keep_possible(spark.range(200_000), id_hash(), bloom_blocks(keys, id_hash(), n), n)
    inside, strangers = found.agg(F.count_if(F.col("id") < 10000), F.count_if(F.col("id") >= 10000)).first()
    assert inside == 10_000
    assert strangers / 190_000 < 0.02


def test_bounded_size_never_loses_a_key(spark, blocks):
    blocks(64)
    n = blocks_for(spark, 10_000)
    table = bloom_blocks(spark.range(10_000), id_hash(), n)
    assert n == 64 and table.count() <= 64
    assert keep_possible(spark.range(10_000), id_hash(), table, n).count() == 10_000


def test_empty_filter_and_null_keys(spark):
    rows = spark.createDataFrame([(1,), (None,)], "id long")
    n = blocks_for(spark, 0)
    assert n == 1
    assert keep_possible(rows, id_hash(), bloom_blocks(rows.limit(0), id_hash(), n), n).isEmpty()


def test_filters_without_a_shuffle_of_the_rows(spark):
    plan = keep_possible(spark.range(10), id_hash(), spark.createDataFrame([(0, 1)], "block int, bits long"), 1)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
