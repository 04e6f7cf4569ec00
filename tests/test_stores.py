import hashlib
import os

import pytest
from pyspark.sql import functions as F

from stowline import settings
from stowline.functions.digests import digest_by_path
from stowline.operators import duplicates as dup
from stowline.sources import stores

NAMES = ["a b.txt", "100%.txt", "%20.txt", "é ü.txt", "日本.txt", "a#b?c.txt", "plus+&=.txt", "x:y.txt"]


@pytest.fixture
def folder(tmp_path):
    for name in NAMES:
        (tmp_path / name).write_text(name)
    return tmp_path


def test_keys_stand_as_they_are(spark, folder):
    rows = [(f"{head}{folder}/{name}", len(name.encode())) for name in NAMES for head in ("", "file://", "file:", "FILE://")]
    found = digest_by_path(spark.createDataFrame(rows, "path string, size long")).collect()
    assert {r.path: (r.digest, r.error) for r in found} == {
        p: (hashlib.sha256(os.path.basename(p).encode()).hexdigest(), None) for p, _ in rows}


def test_what_cannot_be_read_is_a_reject(spark, folder):
    os.symlink("/proc/self/mem", folder / "unreadable")
    (folder / "sub").mkdir()
    rows = [f"file://{folder}/gone.txt", f"file://{folder}/sub", f"file://{folder}/unreadable", "zz9://bucket/key",
            f"file://{folder}/a b.txt", "file://", "nothing", "s3a:///no-bucket", "http://host/x", "", "hdfs:"]
    found = {r.path: r for r in digest_by_path(spark.createDataFrame([(p, None) for p in rows],
                                                                     "path string, size long")).collect()}
    assert len(found) == len(rows)
    assert [p for p in rows if found[p].error is None] == [f"file://{folder}/a b.txt"]
    assert found[rows[0]].error == found[rows[1]].error == "missing"
    assert found["zz9://bucket/key"].error.startswith("unreadable")


def test_an_unreadable_uri_leaves_its_group(spark, folder):
    (folder / "twin").write_text("a b.txt")
    files = spark.createDataFrame([(p, p, 7) for p in (f"file://{folder}/a b.txt", f"file://{folder}/twin",
                                                       "zz9://bucket/key", f"file://{folder}/gone")],
                                  "path string, rel_path string, size long")
    assert [r.n_files for r in dup.digest_groups(dup.digest_table(files)).collect()] == [2]


@pytest.mark.parametrize("path, parts", [
    ("s3a://b/k y%.txt", ("s3", "b", "/k y%.txt")), ("s3n://b", ("s3", "b", "")), ("s3://b//k", ("s3", "b", "//k")),
    ("gs://b/é", ("gs", "b", "/é")), ("/a:b/c", ("file", "", "/a:b/c")), ("file:/a\nb", ("file", "", "/a\nb")),
    ("hdfs://host:8020/x", ("hdfs", "host:8020", "/x")), ("rel/x", ("file", "", "rel/x"))])
def test_split_uri(path, parts):
    assert stores.split_uri(path) == parts


def test_one_store_for_each_bucket(monkeypatch):
    opened = []

    class Store:
        @staticmethod
        def from_uri(uri):
            opened.append(uri)
            return object(), "b" + str(len(opened))

    monkeypatch.setattr(stores.fs, "FileSystem", Store)
    stores._store.cache_clear()
    places = [stores.locate(p)[1] for p in ("s3a://b/x", "s3://b/y z", "s3n://b/%", "s3://c/x")]
    stores._store.cache_clear()
    assert opened == ["s3://b/", "s3://c/"]
    assert places == ["b1/x", "b1/y z", "b1/%", "b2/x"]


def test_tasks_read_equal_bytes(spark, monkeypatch):
    monkeypatch.setattr(stores, "OPEN_BYTES", 10)
    monkeypatch.setattr(settings, "reading_tasks", lambda spark: 12)
    # A third of the files under one path prefix, sizes from 0 to 999, unequal parts to begin with.
    files = spark.range(20_000).select(F.concat(F.lit("/p/"), F.col("id")).alias("path"), F.when(
        F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(1000))).alias("size"))
    files = files.repartitionByRange(5, F.col("size"))
    dealt = stores.deal_by_bytes(files)
    assert dealt.columns == ["path", "size"]
    bytes_ = [r[1] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.coalesce("size", F.lit(0)) + 10)).collect()]
    assert len(bytes_) == 12 and max(bytes_) < 2 * min(bytes_)
    assert dealt.exceptAll(files).isEmpty() and dealt.count() == 20_000
    assert stores.deal_by_bytes(files.limit(0)).isEmpty()
    one = stores.deal_by_bytes(files.limit(1))
    assert one.count() == 1
