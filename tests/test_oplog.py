import pytest

from stowline.sources import oplog

OPS = "operation_type string, source_path string, destination_path string, status string, n int"


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    oplog.create(spark, path)
    return path


@pytest.fixture
def ops(spark):
    def make(names, status="SUCCESS"):
        return spark.createDataFrame([("organize", f"/a/{n}", f"/b/{n}", status, i) for i, n in enumerate(names)], OPS)
    return make


def rows(spark, path):
    return [(r.id, r.batch_id, r.source_path) for r in oplog.read_log(spark, path).orderBy("id").collect()]


def test_a_batch_is_appended_once(spark, log, ops):
    for _ in range(3):
        oplog.append(spark, log, ops("xyz"), ["n"], "b1")
    oplog.append(spark, log, ops("uv"), ["n"], "b2")
    oplog.append(spark, log, ops("xyz"), ["n"], "b1")
    assert rows(spark, log) == [(1, "b1", "/a/x"), (2, "b1", "/a/y"), (3, "b1", "/a/z"), (4, "b2", "/a/u"), (5, "b2", "/a/v")]


def test_a_broken_append_is_finished_in_its_place(spark, log, ops):
    oplog._reserve(spark, log, "b1", 2, 2)  # reserved, and then the job was lost
    oplog.append(spark, log, ops("uv"), ["n"], "b2")
    assert [r[:2] for r in rows(spark, log)] == [(3, "b2"), (4, "b2")]
    with pytest.raises(ValueError, match="b1"):
        oplog.append(spark, log, ops("xyz"), ["n"], "b1")
    oplog.append(spark, log, ops("xy"), ["n"], "b1")
    oplog.append(spark, log, ops("xy"), ["n"], "b1")
    assert rows(spark, log) == [(1, "b1", "/a/x"), (2, "b1", "/a/y"), (3, "b2", "/a/u"), (4, "b2", "/a/v")]


def test_two_writers_take_different_ids(spark, log, ops, monkeypatch):
    oplog.append(spark, log, ops("o"), ["n"], "b0")
    kept, late = oplog._create, []

    def create(spark, path, text):
        # Between looking for the next number and taking it, another writer is faster.
        if not late:
            late.append(path)
            oplog.append(spark, log, ops("pq"), ["n"], "fast")
        return kept(spark, path, text)

    monkeypatch.setattr(oplog, "_create", create)
    oplog.append(spark, log, ops("xyz"), ["n"], "slow")
    assert rows(spark, log) == [(1, "b0", "/a/o"), (2, "fast", "/a/p"), (3, "fast", "/a/q"),
                                (4, "slow", "/a/x"), (5, "slow", "/a/y"), (6, "slow", "/a/z")]


def test_appends_go_after_files_without_one(spark, tmp_path, ops):
    path = str(tmp_path / "old")
    spark.createDataFrame([(41, "old", "ORGANIZE", "/a", "/b", None, "SUCCESS", None)], oplog.SCHEMA).write.parquet(path)
    assert oplog.latest_batch_id(oplog.newest_success(spark, path)) == "old"
    oplog.append(spark, path, ops("x"), ["n"], "new")
    assert [r[:2] for r in rows(spark, path)] == [(41, "old"), (42, "new")]


def test_the_newest_success_is_found_without_a_scan(spark, log, ops):
    oplog.append(spark, log, ops("xyz"), ["n"], "b1")
    oplog.append(spark, log, ops("uv"), ["n"], "b2")
    oplog.append(spark, log, ops("pq", "FAILED"), ["n"], "b3")
    oplog.append(spark, log, ops(""), ["n"], "b4")
    oplog._reserve(spark, log, "b5", 1, 1)  # not written
    newest = oplog.newest_success(spark, log)
    assert {f.split("/")[-2] for f in newest.inputFiles()} == {"append-000000002"}
    assert oplog.latest_batch_id(newest) == oplog.latest_batch_id(oplog.read_log(spark, log)) == "b2"
    assert len(oplog.read_log(spark, log).inputFiles()) > len(newest.inputFiles())


def test_an_empty_log(spark, log, ops):
    assert oplog.latest_batch_id(oplog.newest_success(spark, log)) is None
    oplog.append(spark, log, ops(""), ["n"], "b1")
    assert rows(spark, log) == []
