import random

import pytest
from pyspark.sql import functions as F

from stowline.operators import steps


def played(thresholds, counter):
    lost = []
    for c in thresholds:
        lost.append(c > counter)
        counter += lost[-1]
    return lost, counter


@pytest.mark.parametrize("seed", range(30))
def test_functions_of_ranges(seed):
    draw = random.Random(seed)
    thresholds = [draw.randint(-3, draw.choice([3, 10, 60])) + draw.choice([0, i // 2]) for i in range(draw.randint(0, 60))]
    breakpoints = []
    for n, c in enumerate(thresholds, 1):
        steps.add_step(breakpoints, c)
        assert breakpoints == sorted(set(breakpoints)) and len(breakpoints) <= n
        for g in range(-1, 70):
            assert steps.after_steps(breakpoints, g) == played(thresholds[:n], g)[1]


@pytest.mark.parametrize("range_rows", [50_000, 100, 7])
def test_groups_of_any_length(spark, monkeypatch, range_rows):
    monkeypatch.setattr(steps, "RANGE_ROWS", range_rows)
    draw = random.Random(5)
    sizes = [400, 1, 0, 90, 3, 3, 200, 1]
    rows = [(f"d{k % 3}", f"n{k}", slot, draw.randint(-1, 30) + slot // 8, -(k % 2), "x")
            for k, n in enumerate(sizes) for slot in range(n)]
    shuffled = draw.sample(rows, len(rows))
    table = steps.stage(spark.createDataFrame(
        shuffled, "directory string, name string, slot long, threshold long, counter long, more string"), "rows")
    done = steps.lost_rows(table, ["directory", "name"], "slot")
    assert sorted(done.columns) == sorted([*table.columns, "lost"])
    got = {(r.name, r.slot): r.lost for r in done.collect()}
    assert len(got) == len(rows)
    for k, n in enumerate(sizes):
        own = [r for r in rows if r[1] == f"n{k}"]
        assert [got[f"n{k}", slot] for slot in range(n)] == played([r[3] for r in own], -(k % 2))[0]


def test_no_group_function_is_left(spark):
    from stowline.operators import naming

    names = [f"a ({k}).txt" for k in range(1, 40)] + ["a.txt"] * 5
    requests = spark.createDataFrame([("d", n, i) for i, n in enumerate(names)], "directory string, name string, seq long")
    occupied = spark.createDataFrame([("d", "a.txt")], "directory string, name string")
    seen = []
    kept = naming.stage
    naming.stage = lambda df, label, **m: seen.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, label, **m)
    try:
        found = naming.unique_names(requests, occupied, ["seq"])
        plan = "".join(seen) + found._jdf.queryExecution().executedPlan().toString()
    finally:
        naming.stage = kept
    assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan
    assert found.filter(F.col("name") == "a.txt").count() == 5
