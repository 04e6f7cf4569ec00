import hashlib
import os

import pytest
from pyspark.sql import functions as F

from stowline.functions.digests import check_algorithm, content_digest, digest_by_path
from stowline.operators import duplicates as dup


@pytest.mark.parametrize("algorithm", [
    None, "md5", "sha1", "sha224", "sha256", "sha384", "sha512", "sha3_256", "blake2b", "SHA256"])
def test_digest_equals_hashlib(spark, algorithm):
    bodies = ["", "hello world", "é\n", "x" * 100_000]
    rows = spark.createDataFrame([(b,) for b in [*bodies, None]], "b string").select(
        "b", content_digest(F.col("b"), algorithm).alias("d")).collect()
    assert {r.b: r.d for r in rows} == {None: None, **{
        b: hashlib.new((algorithm or "sha256").lower(), b.encode()).hexdigest() for b in bodies}}


def test_algorithm_check():
    assert check_algorithm(None) == "sha256" and check_algorithm("MD5") == "md5"
    for bad in ("not-a-real-algorithm", "shake_128", ""):
        with pytest.raises(ValueError):
            check_algorithm(bad)


def test_digest_by_path(spark, tmp_path):
    bodies = {"a": b"hello world", "empty": b"", "big": b"x" * (3 << 20)}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "folder").mkdir()
    files = spark.createDataFrame([(str(tmp_path / n),) for n in [*bodies, "gone", "folder"]], "path string")
    got = {os.path.basename(r.path): (r.digest, r.error)
           for r in digest_by_path(files, chunk_bytes=1 << 20).collect()}
    assert got == {**{n: (hashlib.sha256(b).hexdigest(), None) for n, b in bodies.items()},
                   "gone": (None, "missing"), "folder": (None, "missing")}


def found(files):
    members = dup.digest_members(dup.digest_table(files))
    groups = {}
    for r in sorted(members.collect(), key=lambda r: (r.digest, r.member_no)):
        groups.setdefault(r.digest, []).append(r.rel_path)
    return sorted(groups.values())


@pytest.mark.parametrize("bodies, expected", [
    ({"a": "same content", "b": "same content"}, [["a", "b"]]),
    ({"a": "content one", "b": "content two"}, []),
    ({"b": "same", "a": "same", "c": "same"}, [["a", "b", "c"]]),
    ({"a": "first group", "b": "first group", "c": "second group", "d": "second group"},
     [["a", "b"], ["c", "d"]]),
    ({"only": "unique"}, []), ({}, []),
    ({"a-b": "z", "a/x": "z"}, [["a/x", "a-b"]]),
])
def test_groups(inventory, bodies, expected):
    assert found(inventory(bodies.items())) == expected


def test_recoverable_bytes(inventory):
    files = inventory([("a", "data" * 100), ("b", "data" * 100), ("c", "data" * 50), ("d", "data" * 50),
                       ("e", "data" * 50), ("z1", ""), ("z2", "")])
    groups = dup.digest_groups(dup.digest_table(files)).collect()
    assert sorted((r.n_files, r.recoverable) for r in groups) == [(2, 0), (2, 400), (3, 400)]
    assert inventory([]).agg(dup.recoverable(F.count("*"), F.lit(5)).alias("r")).first().r == 0


def test_any_limit_finds_the_same(spark, limits, inventory):
    files = inventory([(f"d{i % 7}/f{i}", "x" * (i % 23) + str(i % 3)) for i in range(300)]
                      + [(f"hot{i}", "hot") for i in range(150)] + [("one", "y" * 77)])
    plain = found(files)
    limits(broadcast=0)
    assert found(files) == plain
    limits(hot=20)
    assert found(files) == plain
    limits(broadcast=3)
    assert found(files) == plain


def test_only_shared_sizes_are_digested(inventory):
    files = inventory([("a", "12"), ("b", "34"), ("c", "567")])
    assert sorted(r.rel_path for r in dup.digest_table(files).collect()) == ["a", "b"]


def test_contents_are_digested_after_the_size_filter(inventory):
    plan = dup.with_shared_size(inventory([("a", "12"), ("b", "34")]))[0].select(
        F.sha2("content", 256))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("sha2") < plan.index("LeftSemi" if "LeftSemi" in plan else "LeftAnti")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_long_size_lists_go_through_a_bloom_filter(spark, limits, monkeypatch):
    """Only candidates and a few strangers are digested, their contents in no shuffle."""
    alone, shared = 6000, 2000  # sizes that one file has, and that two have
    files = spark.range(alone + 2 * shared).select(
        F.when(F.col("id") < alone, F.col("id")).otherwise(alone + (F.col("id") - alone) % shared).alias("size"),
        F.concat(F.lit("/r/"), "id").alias("path"), F.col("id").cast("string").alias("rel_path"))
    files = files.select("*", F.rpad(F.lit("x"), F.col("size").cast("int"), "y").alias("content"))
    limits(broadcast=100)
    rows, plans = {}, {}
    kept = dup.stage

    def seen(df, label, **measures):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        out = kept(df, label, **measures)
        rows[label] = out.staged_measures["rows"]
        return out

    monkeypatch.setattr(dup, "stage", seen)
    table = dup.digest_table(files)
    assert table.count() == 2 * shared
    assert {r[0] for r in table.select("size").distinct().collect()} == set(range(alone, alone + shared))
    strangers = rows["digested"] - 2 * shared
    print(f"strangers digested: {strangers} of {alone}")
    assert 0 <= strangers / alone < 0.02
    assert "sha2" in plans["digested"] and "hashpartitioning" not in plans["digested"].split("sha2")[0]
    assert "SortMergeJoin" not in plans["digested"]


def test_rejects_leave_their_groups(spark):
    rows = [("a", 4, "same"), ("b", 4, "same"), ("c", 4, "longer"), ("d", 4, None)]
    files = spark.createDataFrame([(f"/r/{n}", n, s, c) for n, s, c in rows],
                                  "path string, rel_path string, size long, content string")
    table = dup.digest_table(files)
    assert {r.rel_path: r.error for r in table.collect()} == {
        "a": None, "b": None, "c": "size mismatch", "d": "missing"}
    assert found(files) == [["a", "b"]]
    assert found(files.filter("rel_path != 'b'")) == []


def test_path_backed_inventory(spark, tmp_path, limits):
    for name, body in {"a": "12", "b": "12", "c": "34", "d": "5"}.items():
        (tmp_path / name).write_text(body)
    files = spark.createDataFrame([(str(tmp_path / n), n, s) for n, s in
                                   [("a", 2), ("b", 2), ("c", 2), ("d", 1), ("gone", 2)]],
                                  "path string, rel_path string, size long")
    assert found(files) == [["a", "b"]]
    limits(broadcast=0)
    assert found(files) == [["a", "b"]]


def test_group_numbers_and_join(inventory, monkeypatch):
    monkeypatch.setattr(dup, "CHUNK_MEMBERS", 2)
    files = inventory([("b", "22"), ("z", "22"), ("a", "11"), ("y", "11"), ("q", "longest"),
                       ("r", "longest"), *[(f"m{i}", "7") for i in range(7)]])
    members = dup.digest_members(dup.digest_table(files))
    groups = dup.number_groups(dup.groups_of(members))
    joined = dup.join_groups(members, groups.select("digest", "n_files", "group_no")).collect()
    assert sorted((r.group_no, r.member_no, r.rel_path) for r in joined) == [
        (1, 1, "q"), (1, 2, "r"), (2, 1, "a"), (2, 2, "y"), (3, 1, "b"), (3, 2, "z"),
        *[(4, i + 1, f"m{i}") for i in range(7)]]
