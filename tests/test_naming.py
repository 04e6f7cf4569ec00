"""Names given to a whole batch against the rule played one request at a time."""

import random
from pathlib import PurePosixPath

import pytest

from stowline.operators import steps
from stowline.operators.naming import unique_names


def play(requests, occupied):
    """requests: name list in order; occupied: set of names."""
    used, given = set(occupied), []
    for name in requests:
        path, k, candidate = PurePosixPath(name), 0, name
        while candidate in used:
            k += 1
            candidate = f"{path.stem} ({k}){path.suffix}"
        used.add(candidate)
        given.append(candidate)
    return given


def check(spark, cases):
    asked = [(f"d{d}", n, i) for d, (names, _) in enumerate(cases) for i, n in enumerate(names)]
    there = [(f"d{d}", n) for d, (_, occupied) in enumerate(cases) for n in occupied]
    random.Random(0).shuffle(asked)
    requests = spark.createDataFrame(asked, "directory string, name string, seq long")
    occupied = spark.createDataFrame(there, "directory string, name string")
    got = {(r.directory, r.seq): r.final_name
           for r in unique_names(requests, occupied, ["seq"]).collect()}
    wrong = []
    for d, (names, occupied_names) in enumerate(cases):
        result = [got.pop((f"d{d}", i)) for i in range(len(names))]
        if result != play(names, occupied_names):
            wrong.append((names, occupied_names, result))
    assert not wrong, wrong[:2]
    assert not got


def random_cases(seed, count, pool, most_asked=14, most_there=8):
    draw = random.Random(seed)
    cases = []
    for _ in range(count):
        names = draw.sample(pool, draw.randint(1, min(6 if most_asked < 300 else 60, len(pool))))
        weights = [draw.random() ** 3 + 0.02 for _ in names]
        cases.append((draw.choices(names, weights, k=draw.randint(1, most_asked)),
                      set(draw.sample(pool, draw.randint(0, min(most_there, len(pool)))))))
    return cases


PLAIN = ["a.txt"] + [f"a ({k}).txt" for k in range(0, 9)] + ["a (01).txt", "b", "b (1)", "b (2)"]
NESTED = ["a.txt"] + [f"a ({i}).txt" for i in range(1, 7)] + [
    f"a ({i}) ({j}).txt" for i in (1, 2, 3) for j in (1, 2)] + ["a (1) (1) (1).txt"]
BARE = ["r", "r (1)", "r (2)", "r (3)", "r (1) (1)", ".h", ".h (1)", ".h (2)", ".h (1) (1)"]
DOTTED = ["y.", "y. (1)", "y. (2)", "y (1).", "y (2).", "y (1). (1)", "y (2). (1)", "y (1) (1).", "x.t"]


def test_expected_names(spark):
    check(spark, [
        (["photo.jpg"], {"photo.jpg"}),
        (["photo.jpg"], {"photo.jpg", "photo (1).jpg"}),
        (["photo.jpg", "photo.jpg"], {"photo (1).jpg"}),
        (["a.tar.gz"], {"a.tar.gz"}),
        (["x (1).txt", "x.txt"], {"x.txt"}),
        (["x.txt", "x (1).txt"], {"x.txt"}),
        (["x.txt"] * 5, {"x (2).txt", "x (4).txt"}),
    ])


@pytest.mark.parametrize("pool, hot", [
    (PLAIN, False), (NESTED, False), (BARE, False), (DOTTED, False), (NESTED, True), (DOTTED, True)],
    ids=["plain", "nested", "bare", "dotted", "nested-hot", "dotted-hot"])
def test_random_batches(spark, limits, pool, hot):
    if hot:
        limits(hot=2, broadcast=3)
    check(spark, random_cases(11, 300, pool))


@pytest.mark.parametrize("pool", [NESTED, BARE], ids=["nested", "bare"])
def test_random_batches_in_short_ranges(spark, monkeypatch, pool):
    monkeypatch.setattr(steps, "RANGE_ROWS", 5)
    check(spark, random_cases(13, 200, pool))


def test_one_long_family_in_short_ranges(spark, monkeypatch):
    monkeypatch.setattr(steps, "RANGE_ROWS", 7)
    pool = ["a.txt"] * 30 + [f"a ({k}).txt" for k in range(1, 80)] + [f"a ({k}) (1).txt" for k in range(1, 40)]
    check(spark, random_cases(14, 6, pool, most_asked=400, most_there=20))


def test_long_batches(spark):
    check(spark, random_cases(12, 40, NESTED + [f"a ({k}).txt" for k in range(7, 60)],
                              most_asked=200, most_there=40))
