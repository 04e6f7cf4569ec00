import pytest

from stowline.operators.moves import apply_moves
from stowline.plans import organize, reports, undo
from stowline.sources import oplog



@pytest.fixture
def organised(spark, inventory, tmp_path):
    """A log and a lake after organising the given files."""
    def make(*names):
        log = str(tmp_path / "log")
        oplog.create(spark, log)
        files = inventory([(n, "") for n in names])
        out = organize.execute_plan(organize.plan_moves(files, "/lake"), files)
        oplog.append(spark, log, organize.organize_operations(out), ["scan_key", "source_path"], "b1")
        return log, apply_moves(files.select("path"), out)
    return make


def paths(spark, values):
    return spark.createDataFrame([(v,) for v in values], "path string")


def reverse(spark, log):
    table = oplog.read_log(spark, log)
    return undo.reverse_operations(table, oplog.latest_batch_id(table))


def test_files_go_back_last_first(spark, organised):
    log, lake = organised("notes.txt", "photo.jpg")
    back = reverse(spark, log)
    assert [(r.undo_seq, r.current_path, r.original_path) for r in back.orderBy("undo_seq").collect()] == [
        (1, "/lake/Images/photo.jpg", "/lake/photo.jpg"), (2, "/lake/Documents/notes.txt", "/lake/notes.txt")]
    out = undo.execute_undo(back, lake)
    assert {r.path for r in apply_moves(lake, out).collect()} == {"/lake/photo.jpg", "/lake/notes.txt"}
    assert undo.undo_summary(out).first() == (2, 0, False)


def test_an_occupied_original(spark, organised):
    log, lake = organised("photo.jpg")
    now = lake.select("path").unionByName(paths(spark, ["/lake/photo.jpg"]))
    out = undo.execute_undo(reverse(spark, log), now)
    assert [r.final_path for r in out.collect()] == ["/lake/photo (1).jpg"]


def test_other_batches_stay(spark, organised):
    log, lake = organised("a.txt")
    older = spark.createDataFrame([("ORGANIZE", "/lake/u.txt", "/lake/Other/u.txt", 1)],
                                  "operation_type string, source_path string, destination_path string, n int")
    oplog.append(spark, log, older, ["n"], "b0")
    table = oplog.read_log(spark, log)
    back = undo.reverse_operations(table, "b1").collect()
    assert [r.current_path for r in back] == ["/lake/Documents/a.txt"]


def test_a_missing_file_fails_alone(spark, organised):
    log, lake = organised("a.txt", "b.txt")
    out = undo.execute_undo(reverse(spark, log), lake.filter("name != 'b.txt'"))
    rows = {r.source_path: (r.destination_path, r.status, r.error_message)
            for r in undo.undo_operations(out).collect()}
    assert rows == {"/lake/Documents/a.txt": ("/lake/a.txt", "SUCCESS", None),
                    "/lake/Documents/b.txt": ("/lake/b.txt", "FAILED", "File missing")}
    assert undo.undo_summary(out).first() == (1, 1, False)
    none = undo.execute_undo(reverse(spark, log), paths(spark, []))
    assert undo.undo_summary(none).first() == (0, 2, True)


def test_a_file_named_twice_goes_back_once(spark, tmp_path):
    log = str(tmp_path / "log")
    oplog.create(spark, log)
    ops = spark.createDataFrame([("ORGANIZE", "/in/a", "/out/x", 1), ("ORGANIZE", "/in/b", "/out/x", 2)],
                                "operation_type string, source_path string, destination_path string, n int")
    oplog.append(spark, log, ops, ["n"], "b")
    out = undo.execute_undo(reverse(spark, log), paths(spark, ["/out/x"]))
    assert {r.destination_path: r.status for r in out.collect()} == {"/in/b": "SUCCESS", "/in/a": "FAILED"}


def test_undo_is_not_undone(spark, organised):
    log, lake = organised("a.txt")
    out = undo.execute_undo(reverse(spark, log), lake)
    oplog.append(spark, log, undo.undo_operations(out), ["undo_seq"], "u1")
    table = oplog.read_log(spark, log)
    assert oplog.latest_batch_id(table) == "u1"
    assert reverse(spark, log).count() == 0


def test_only_reversible_rows(spark):
    rows = [(1, "b", "ORGANIZE", "/a", "/x", "SUCCESS"), (2, "b", "ORGANIZE", "/b", "/y", "FAILED"),
            (3, "b", "UNDO", "/c", "/z", "SUCCESS"), (4, "b", "DUPLICATE_REVIEW", "/d", "/w", "SUCCESS"),
            (5, "b", "ORGANIZE", "/e", "/e", "SUCCESS")]
    log = spark.createDataFrame(rows, "id long, batch_id string, operation_type string, "
                                      "source_path string, destination_path string, status string")
    back = undo.reverse_operations(log, "b").orderBy("undo_seq").collect()
    assert [r.current_path for r in back] == ["/w", "/x"]


def test_preview(spark, organised):
    log, _ = organised("photo.jpg")
    lines = [r.line for r in reports.undo_preview(reverse(spark, log)).orderBy("undo_seq", "line_no").collect()]
    assert lines == ["Undo preview:", "", "1. Move:", "   /lake/Images/photo.jpg", "", "   Back to:",
                     "   /lake/photo.jpg", "", "Total files to restore: 1"]


def test_nothing_to_undo(spark, tmp_path):
    oplog.create(spark, str(tmp_path / "log"))
    assert reverse(spark, str(tmp_path / "log")).count() == 0
