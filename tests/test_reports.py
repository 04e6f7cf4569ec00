from datetime import datetime

from stowline.operators import duplicates as dup
from stowline.plans import organize, reports
from stowline.sources.reports import write_report
from stowline.sources.staging import stage


def text(lines, *order):
    return [r.line for r in lines.orderBy(*order).collect()]


def test_scan_listing(inventory):
    files = inventory([("a-b", ""), ("a/x", ""), ("c", "")])
    assert text(reports.scan_listing(files, "/lake"), "line_no") == [
        "Scanned directory: /lake", "Found 3 file(s).", "", "  /lake/a/x", "  /lake/a-b", "  /lake/c"]
    assert text(reports.scan_listing(files, "/lake", limit=2), "line_no")[3:] == [
        "  /lake/a/x", "  /lake/a-b", "  ... and 1 more."]
    assert text(reports.scan_listing(inventory([]), "/lake"), "line_no") == [
        "Scanned directory: /lake", "Found 0 file(s).", ""]


def test_plan_preview(inventory):
    plan = organize.plan_moves(inventory([("b.txt", ""), ("a.jpg", "")]), "/lake")
    one = ["1. a.jpg", "   From: /lake/a.jpg", "   To:   /lake/Images/a.jpg", ""]
    assert text(reports.plan_preview(plan), "line_no") == [
        "Planned operations:", "", *one, "2. b.txt", "   From: /lake/b.txt",
        "   To:   /lake/Documents/b.txt", "", "Total files to move: 2"]
    assert text(reports.plan_preview(plan, limit=1), "line_no") == [
        "Planned operations:", "", *one, "... and 1 more.", "", "Total files to move: 2"]
    assert text(reports.plan_preview(plan.limit(0)), "line_no") == [
        "Planned operations:", "", "Total files to move: 0"]


def test_duplicates_report(inventory):
    members = stage(dup.digest_members(dup.digest_table(
        inventory([("a", "x" * 2000), ("b", "x" * 2000), ("c", "1"), ("d", "1")]))), "members")
    order = ["group_no", "part", "member_no", "line_no"]
    lines = text(reports.duplicates_report(members, dup.number_groups(dup.groups_of(members)), "/lake"), *order)
    assert lines[:4] == ["Scanned: /lake", "Found 2 duplicate group(s).", "", "Duplicate group 1"]
    assert lines[4] == "" and lines[5].startswith("Hash: ") and lines[6:] == [
        "", "Files:", "1. /lake/a", "   Size: 2.0 KB", "2. /lake/b", "   Size: 2.0 KB", "",
        "Potential space that can be recovered: 2.0 KB", "", "Duplicate group 2", "", lines[17], "",
        "Files:", "1. /lake/c", "   Size: 1 B", "2. /lake/d", "   Size: 1 B", "",
        "Potential space that can be recovered: 1 B", ""]
    none = members.limit(0)
    assert text(reports.duplicates_report(none, dup.number_groups(dup.groups_of(none)), "/lake"), *order) == [
        "Scanned: /lake", "No duplicate files found."]


def test_history_lines(spark):
    rows = [(2, "DUPLICATE_REVIEW", datetime(2024, 1, 2, 3, 4, 5), "/a", "/b", "SUCCESS"),
            (1, "UNDO", datetime(2024, 1, 2, 3, 4, 5, 60), "/c", "/d", "FAILED")]
    log = spark.createDataFrame(rows, "id long, operation_type string, timestamp timestamp_ntz, "
                                      "source_path string, destination_path string, status string")
    assert text(reports.history_lines(log), "id") == [
        "[!] UNDO             2024-01-02T03:04:05.000060+00:00  /c -> /d",
        "[+] DUPLICATE_REVIEW 2024-01-02T03:04:05+00:00  /a -> /b"]


    assert text(reports.history_report(log, limit=1), "line_no") == [
        "Recent operations:", "", "[+] DUPLICATE_REVIEW 2024-01-02T03:04:05+00:00  /a -> /b"]
    assert text(reports.history_report(log.limit(0)), "line_no") == ["No operations recorded yet."]


def test_written_report_reads_back_in_order(spark, tmp_path):
    lines = spark.createDataFrame([(2, "zwei é"), (1, "one"), (3, "")], "line_no int, line string")
    path = tmp_path / "deep" / "report"
    for _ in range(2):
        write_report(lines, str(path), ["line_no"])
    parts = sorted(path.glob("part-*"))
    assert "".join(p.read_text("utf-8") for p in parts) == "one\nzwei é\n\n"


def test_summary_counts(spark):
    assert {tuple(r) for r in reports.summary_counts(a=spark.range(3), b=spark.range(0)).collect()} == {
        ("a", 3), ("b", 0)}
