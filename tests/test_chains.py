import random

import pytest
from pyspark.sql import functions as F

from stowline.operators import chains
from stowline.operators.moves import apply_moves
from stowline.plans import undo
from stowline.settings import FILE_MISSING
from stowline.sources.staging import stage


def undone(spark, log, present):
    """Rows of the outcome and the paths afterwards, of a batch of (source, destination) moves."""
    reverse = spark.createDataFrame([(i + 1, b, a) for i, (a, b) in enumerate(reversed(log))],
                                    "undo_seq long, current_path string, original_path string")
    files = spark.createDataFrame([(p, p) for p in present], "path string, was string")
    outcome = undo.execute_undo(reverse, files)
    after = apply_moves(files, undo.restored_files(outcome))
    return ([(r.undo_seq, r.final_path, r.error_message) for r in outcome.orderBy("undo_seq").collect()],
            {r.was: r.path for r in after.collect()})


def played(log, present):
    """The same, one step after the other."""
    there = {p: p for p in present}  # path -> the file that is there, by its first path
    rows = []
    for i, (original, current) in enumerate(reversed(log), 1):
        if current not in there:
            rows.append((i, None, FILE_MISSING))
            continue
        final, k = original, 0
        while final in there:
            k += 1
            final = f"{original} ({k})"
        there[final] = there.pop(current)
        rows.append((i, final, None))
    return rows, {was: path for path, was in there.items()}


CASES = [
    ([("/a", "/b"), ("/b", "/c")], ["/c"]),                       # back along the chain
    ([("/a", "/b"), ("/b", "/c")], ["/c", "/b"]),                 # the middle is taken: its file moves on
    ([("/a", "/b"), ("/b", "/c")], ["/b"]),
    ([("/b", "/c"), ("/a", "/b")], ["/b", "/c"]),                 # a shift: B is vacated, then taken
    ([("/a", "/t"), ("/b", "/a"), ("/t", "/b")], ["/a", "/b"]),   # a swap through a third name
    ([("/a", "/b"), ("/b", "/a"), ("/a", "/b")], ["/b"]),         # there and back
    ([("/a", "/x"), ("/b", "/x"), ("/x", "/c")], ["/c"]),
    ([("/a", "/x"), ("/a", "/y")], ["/x", "/y"]),                 # two files for one name
    ([], ["/a"]), ([("/a", "/b")], [])]


def test_chains_restore_step_by_step(spark):
    log = [(f"/{k}{a}", f"/{k}{b}") for k, (moves, _) in enumerate(CASES) for a, b in moves]
    present = [f"/{k}{p}" for k, (_, there) in enumerate(CASES) for p in there]
    assert undone(spark, log, present) == played(log, present)


@pytest.mark.parametrize("seed", range(3))
def test_random_batches(spark, limits, seed):
    draw = random.Random(seed)
    log, present = [], []
    for case in range(40):
        names = [f"/{case}/{c}" for c in "abcdefgh"[:draw.randint(3, 8)]]
        log += [tuple(draw.sample(names, 2)) for _ in range(draw.randint(1, 25))]
        present += [n for n in names if draw.random() < 0.5]
    if seed == 1:
        limits(broadcast=0)
    if seed == 2:
        limits(hot=3)
    assert undone(spark, log, present) == played(log, present)


def test_a_thousand_steps(spark):
    log = [(f"/s/{i}", f"/s/{i + 1}") for i in range(1000)]
    rows, after = undone(spark, log, ["/s/1000"])
    assert after == {"/s/1000": "/s/0"}
    assert [r[1] for r in rows] == [f"/s/{i}" for i in range(999, -1, -1)]


def test_rounds_are_the_logarithm_of_the_chain(spark, monkeypatch):
    labels = []
    kept = chains.stage
    monkeypatch.setattr(chains, "stage", lambda df, label, **m: labels.append(label) or kept(df, label, **m))
    steps = kept(spark.range(500).select(F.col("id").alias("move"), (F.col("id") + 1).alias("next")), "chain")
    assert chains.reached(spark.range(1).toDF("move"), steps).count() == 501
    assert labels.count("steps") <= 10
    for n in (1, 2, 3, 7, 500):
        some = kept(steps.filter(F.col("move") < n), "chain")
        assert {r.last for r in chains.ends(some).collect()} == {n}


def test_rounds_broadcast_only_their_part_of_the_limit(spark, limits):
    limits(broadcast=1000)
    for rows, joined in ((5, "BroadcastHashJoin"), (900, "SortMergeJoin")):
        table = stage(spark.range(rows).withColumnRenamed("id", "move"), "moves")
        other = stage(spark.range(2 * rows).withColumnRenamed("id", "move"), "moves")
        found = other.join(chains._small(table), "move", "left_semi")
        assert found.count() == rows
        assert joined in found._jdf.queryExecution().executedPlan().toString()
    last = chains.ends(stage(spark.range(899).selectExpr("id as move", "id + 1 as next"), "steps"))
    assert last.filter("last = 899").count() == last.count() == 899
