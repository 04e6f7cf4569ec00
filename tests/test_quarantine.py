import pytest
from pyspark.sql import functions as F

from stowline.operators import duplicates as dup
from stowline.plans import quarantine
from stowline.sources.staging import stage


def test_choices(spark):
    given = ["s", " S ", "1", " 3\t", "4", "0", "-1", "9x", "1.5", "", None, "+2", "1_0", "\n2\n", "02"]
    rows = spark.createDataFrame([(c,) for c in given], "c string").select(
        "c", quarantine.parse_choice(F.col("c"), F.lit(3)).alias("a")).collect()
    assert {r.c: r.a for r in rows} == {
        "s": "s", " S ": "s", "1": "1", " 3\t": "3", "4": None, "0": None, "-1": None, "9x": None,
        "1.5": None, "": None, None: None, "+2": "2", "1_0": None, "\n2\n": "2", "02": "2"}


@pytest.fixture
def review(spark, inventory):
    def run(files, choices, occupied=(), gone=()):
        members = stage(dup.digest_members(dup.digest_table(inventory(files))), "members")
        groups = dup.groups_of(members)
        first = {r.rel_path: r.digest for r in members.filter("member_no = 1").collect()}
        decisions = spark.createDataFrame([(first[f], c) for f, c in choices], "digest string, choice string")
        decided = quarantine.decide(groups, decisions)
        now = inventory([(n, "") for n in [*dict(files), *occupied] if n not in gone])
        plan = quarantine.plan_review(members, decided, "/lake")
        return decided, quarantine.execute_review(plan, now)
    return run


FILES = [("a/n.txt", "big one"), ("b/n.txt", "big one"), ("c/n.txt", "big one"),
         ("d/n.txt", "small"), ("e/n.txt", "small"), ("f", "12"), ("g", "12"), ("h", "34"), ("i", "34")]


def test_all_but_the_keeper_move(review):
    decided, done = review(FILES, [("a/n.txt", "2"), ("d/n.txt", " 1 "), ("f", "S"), ("h", "9x")],
                           occupied=["Duplicate_Review/n (1).txt"])
    assert {r.source_path: r.final_path for r in done.collect()} == {
        "/lake/a/n.txt": "/lake/Duplicate_Review/n.txt",
        "/lake/c/n.txt": "/lake/Duplicate_Review/n (2).txt",
        "/lake/e/n.txt": "/lake/Duplicate_Review/n (3).txt"}
    assert quarantine.review_summary(decided, done).first() == (3, 2)
    ops = quarantine.review_operations(done).collect()
    assert {(r.operation_type, r.status, r.error_message) for r in ops} == {
        ("DUPLICATE_REVIEW", "SUCCESS", None)}


def test_a_file_that_vanished_is_not_logged(review):
    decided, done = review(FILES, [("a/n.txt", "1")], gone=["b/n.txt"])
    assert [r.source_path for r in done.collect()] == ["/lake/c/n.txt"]
    assert quarantine.review_summary(decided, done).first() == (1, 3)


def test_no_decisions_and_dry_run(spark, review, inventory):
    decided, done = review(FILES, [])
    assert quarantine.review_summary(decided, done).first() == (0, 4)
    groups = dup.digest_groups(dup.digest_table(inventory(FILES)))
    assert quarantine.dry_run_summary(groups).first() == (0, 4)


def test_two_decisions_on_a_group_fail(review):
    with pytest.raises(Exception, match="more than one decision"):
        review(FILES, [("f", "1"), ("f", "2")])
