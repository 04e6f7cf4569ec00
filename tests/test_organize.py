import pytest
from pyspark.sql import functions as F

from stowline.operators.moves import apply_moves
from stowline.operators.scope import in_scope
from stowline.plans import organize
from stowline.sources import oplog


def planned(files, **options):
    return {r.source_path: r.destination_path
            for r in organize.plan_moves(files, "/lake", **options).collect()}


def test_plan(inventory):
    assert planned(inventory([("photo.jpg", ""), ("x/notes.pdf", "")])) == {
        "/lake/photo.jpg": "/lake/Images/photo.jpg", "/lake/x/notes.pdf": "/lake/Documents/notes.pdf"}
    assert planned(inventory([])) == {}


def test_category_folders_are_left_alone(inventory):
    files = inventory([("Images/photo.jpg", ""), ("loose.txt", ""), ("Duplicate_Review/x.txt", "")])
    assert planned(files) == {"/lake/loose.txt": "/lake/Documents/loose.txt"}


def test_include_subfolders(inventory):
    files = inventory([("Documents/photo.jpg", ""), ("Images/ok.jpg", ""), ("Duplicate_Review/x.txt", "")])
    assert planned(files) == {}
    assert planned(files, include_subfolders=True) == {
        "/lake/Documents/photo.jpg": "/lake/Images/photo.jpg"}


def test_a_root_below_a_category_name_plans_nothing(inventory):
    assert planned(inventory([("a.txt", "")], root="/home/Documents/lake")) == {}


def test_application_files(inventory):
    files = inventory([("data/file.db", ""), ("logs/file.log", "")])
    assert planned(in_scope(files)) == {}
    assert planned(files, protected_paths=["/LAKE/data", "e/logs"]) == {}


@pytest.fixture
def run(inventory):
    """Final paths of planned files, given what else exists and what has gone."""
    def outcome(names, occupied=(), gone=()):
        plan = organize.plan_moves(inventory([(n, "") for n in names]), "/lake")
        now = inventory([(n, "") for n in [*names, *occupied] if n not in gone])
        return now, organize.execute_plan(plan, now)
    return outcome


def finals(outcome):
    return {r.source_path: r.final_path for r in outcome.collect()}


def test_conflicts(run):
    _, out = run(["photo.jpg"], ["Images/photo.jpg"])
    assert finals(out) == {"/lake/photo.jpg": "/lake/Images/photo (1).jpg"}
    _, out = run(["photo.jpg", "b/photo.jpg"], ["Images/photo.jpg", "Images/photo (1).jpg"])
    assert finals(out) == {"/lake/b/photo.jpg": "/lake/Images/photo (2).jpg",
                           "/lake/photo.jpg": "/lake/Images/photo (3).jpg"}


def test_a_missing_source_uses_up_no_name(run):
    now, out = run(["a/n.txt", "b/n.txt", "c/n.txt"], gone=["b/n.txt"])
    rows = {r.source_path: (r.final_path, r.status, r.error_message) for r in out.collect()}
    assert rows == {
        "/lake/a/n.txt": ("/lake/Documents/n.txt", "SUCCESS", None),
        "/lake/b/n.txt": (None, "FAILED", "Source file does not exist (deleted meanwhile)."),
        "/lake/c/n.txt": ("/lake/Documents/n (1).txt", "SUCCESS", None)}
    after = {r.path: (r.name, r.extension) for r in apply_moves(now, out).collect()}
    assert after == {"/lake/Documents/n.txt": ("n.txt", "txt"),
                     "/lake/Documents/n (1).txt": ("n (1).txt", "txt")}


def test_any_limit_gives_the_same_names(run, limits):
    names = [f"d{i}/{'n' if i % 3 else 'm'}.txt" for i in range(60)]
    _, out = run(names, ["Documents/n (3).txt", "Documents/n.txt"])
    plain = finals(out)
    limits(hot=5, broadcast=2)
    _, out = run(names, ["Documents/n (3).txt", "Documents/n.txt"])
    assert finals(out) == plain and len(set(plain.values())) == 60


def test_history_of_a_run(spark, run, tmp_path):
    log = str(tmp_path / "log")
    oplog.create(spark, log)
    _, out = run(["a/n.txt", "b/n.txt", "c/n.txt"], gone=["b/n.txt"])
    oplog.append(spark, log, organize.organize_operations(out), ["scan_key", "source_path"])
    oplog.append(spark, log, organize.organize_operations(out), ["scan_key", "source_path"], "second")
    rows = oplog.read_log(spark, log).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4, 5, 6]
    assert [(r.operation_type, r.source_path, r.destination_path, r.status) for r in rows[:3]] == [
        ("ORGANIZE", "/lake/a/n.txt", "/lake/Documents/n.txt", "SUCCESS"),
        ("ORGANIZE", "/lake/b/n.txt", "/lake/Documents/n.txt", "FAILED"),
        ("ORGANIZE", "/lake/c/n.txt", "/lake/Documents/n (1).txt", "SUCCESS")]
    first, second = {r.batch_id for r in rows[:3]}, {r.batch_id for r in rows[3:]}
    assert len(first) == 1 and len(first.copy().pop()) == 16 and second == {"second"}
    assert oplog.latest_batch_id(oplog.read_log(spark, log)) == "second"


@pytest.mark.parametrize("column, value", [("operation_type", "DELETE"), ("status", "MAYBE"), ("status", None)])
def test_log_domains(spark, column, value):
    row = {"operation_type": "undo", "status": "success", column: value}
    ops = spark.createDataFrame([(row["operation_type"], row["status"])], "operation_type string, status string")
    with pytest.raises(Exception, match=f"Invalid {column}"):
        oplog.normalise(ops).collect()


def test_log_defaults(spark):
    ops = spark.createDataFrame([("undo", None), ("Organize", "x")], "operation_type string, batch_id string")
    rows = oplog.normalise(ops, "b").orderBy("operation_type").collect()
    assert [(r.operation_type, r.batch_id, r.status, r.error_message) for r in rows] == [
        ("ORGANIZE", "x", "SUCCESS", None), ("UNDO", "b", "SUCCESS", None)]
    assert dict(oplog.normalise(ops).dtypes)["timestamp"] == "timestamp_ntz"


def test_an_empty_log(spark, tmp_path):
    oplog.create(spark, str(tmp_path / "log"))
    log = oplog.read_log(spark, str(tmp_path / "log"))
    assert oplog.latest_batch_id(log) is None
    assert oplog.batch_operations(log, None).count() == 0


def test_batch_filter_reaches_the_scan(spark, tmp_path):
    oplog.create(spark, str(tmp_path / "log"))
    plan = oplog.batch_operations(oplog.read_log(spark, str(tmp_path / "log")), "b7").select(
        "id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(batch_id,b7)" in plan


def test_plan_is_narrow(inventory):
    plan = organize.plan_moves(inventory([("a", "")]), "/lake")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "hashpartitioning" not in text and "rangepartitioning" not in text


def test_recent_is_a_top_n(spark):
    log = spark.range(1000).withColumn("x", F.lit(1))
    recent = oplog.recent(log)
    assert [r.id for r in recent.collect()] == list(range(999, 899, -1))
    assert "TakeOrderedAndProject" in recent._jdf.queryExecution().executedPlan().toString()
