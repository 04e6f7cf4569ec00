import random
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from stowline.functions.names import (base_name, extension, family, numbered, parent_dir,
                                      scan_key, slots_of)
from stowline.functions.sizes import human_size

NAMES = ["a.txt", "a.tar.gz", "README", ".bashrc", ".a.b", "a.", "y. (1)", "a..b", "..x", "...",
         "A.JPG", "a b.Pdf", "x (1).txt", "x (1) (2).txt", "x (01).txt", "x (0).txt", " (1).txt",
         "x (1)", "é.Ünï", "a\nb.txt", "a.b\nc", "x (99999999999999999999).txt", "x(1).txt"]


def column(spark, values, *exprs):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", *exprs).collect()
    return {r[0]: r for r in rows}


def test_extension_and_parts_equal_pathlib(spark):
    got = column(spark, NAMES, extension(F.col("v")).alias("e"),
                 numbered(F.col("v"), F.lit(7)).alias("n"))
    for name in NAMES:
        path = PurePosixPath(name)
        assert got[name].e == path.suffix.lstrip(".").lower(), name
        assert got[name].n == f"{path.stem} (7){path.suffix}", name


def test_slots_invert_numbering(spark):
    got = column(spark, NAMES, slots_of(F.col("v")).alias("s"))
    for name in NAMES:
        slots = {(s.base, s.slot) for s in got[name].s}
        expected = {(name, 0)}
        for base in {name[:i] + name[j:] for i in range(1, len(name)) for j in range(i, len(name) + 1)}:
            path = PurePosixPath(base)
            for k in (1, 2):
                if f"{path.stem} ({k}){path.suffix}" == name and path.name == base:
                    expected.add((base, k))
        assert slots == expected, name


def test_family_joins_a_name_and_its_numbered_forms(spark):
    values = [f"{PurePosixPath(n).stem} (12){PurePosixPath(n).suffix}" for n in NAMES]
    got = column(spark, NAMES + values, family(F.col("v")).alias("f"))
    for name, child in zip(NAMES, values):
        assert got[name].f == got[child].f


def test_paths_split(spark):
    got = column(spark, ["/a/b.c", "/x", "rel"], base_name(F.col("v")).alias("b"),
                 parent_dir(F.col("v")).alias("p"))
    assert [tuple(got[v])[1:] for v in ("/a/b.c", "/x")] == [("b.c", "/a"), ("x", "")]


def test_scan_key_orders_like_component_lists(spark):
    paths = ["a/x", "a-b", "a", "a.txt", "a/b/c", "a/b", "B", "é/a", "é", "z/é", "z/\U0001f600", "z/ﬀ"]
    random.Random(1).shuffle(paths)
    ordered = [r.v for r in spark.createDataFrame([(p,) for p in paths], "v string")
               .orderBy(scan_key(F.col("v"))).collect()]
    assert ordered == sorted(paths, key=lambda p: p.split("/"))


def human(size):
    value = float(max(size, 0))
    if value < 1024:
        return f"{int(value)} B"
    for unit in ("KB", "MB", "GB", "TB"):
        value /= 1024
        if value < 1024 or unit == "TB":
            return f"{value:.1f} {unit}"


def test_human_size(spark):
    draw = random.Random(2)
    sizes = {0, -5, 1, 1023, 1024, 1280, 1075, 1126, 1048575, 1048576, 1024 ** 4, 5 * 1024 ** 5,
             1024 ** 3 - 1, 2 ** 53}
    sizes |= {draw.randrange(0, 2 ** draw.randrange(1, 55)) for _ in range(3000)}
    sizes |= {n * 1024 // 20 for n in range(2000)} | {n * 128 for n in range(8000)}
    rows = spark.createDataFrame([(s,) for s in sizes], "s bigint").select(
        "s", human_size(F.col("s")).alias("h")).collect()
    assert [(r.s, r.h) for r in rows if r.h != human(r.s)] == []
