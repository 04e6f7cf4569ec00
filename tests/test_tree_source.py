import os

import pytest
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stowline.sources import stores, tree_source
from stowline.sources.tree import scan_tree
from stowline.sources.tree_source import PrunedTreeReader, TreeReader, TreeSource


@pytest.fixture
def make(tmp_path):
    def files(*names, body="data"):
        for name in names:
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(body)
        return str(tmp_path)
    return files


@pytest.fixture
def tree(spark):
    spark.dataSource.register(TreeSource)

    def load(root, **options):
        return spark.read.format("stowline_tree").options(**options).load(root)
    return load


NAMES = ["a.txt", "sub/b.PDF", "sub/deep/c.txt", "sub/deep/er/d", "x/.h/y", ".secret", "Documents/in.pdf", "mine/z", "é ü%/f"]


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_same_rows_as_the_level_scan(spark, make, tree, depth):
    root = make(*NAMES)
    os.symlink(f"{root}/sub", f"{root}/linked")
    os.symlink(f"{root}/a.txt", f"{root}/link.txt")
    os.symlink(f"{root}/nowhere", f"{root}/broken")
    for options, same in (({}, {}), ({"recursive": "false"}, {"recursive": False}),
                          ({"includeHidden": "true"}, {"include_hidden": True}), ({"ignore": "mine,deep"}, {"ignore": ["mine", "deep"]})):
        files, rejects = scan_tree(spark, root, tasks=2, **same)
        found = tree(root, splitDepth=str(depth), **options)
        columns = ["path", "rel_path", "name", "extension", "size", "modified"]
        rows = found.filter("error is null").select(columns)
        if options.get("recursive") == "false":
            rows, files = rows.filter("name != 'link.txt'"), files.filter("name != 'link.txt'")
        assert sorted(rows.collect()) == sorted(files.select(columns).collect())
        assert [r.rel_path for r in found.filter("error is not null").collect()] == ["broken"]


def reader(root, **options):
    return PrunedTreeReader({"path": root, **options})


def test_planned_partitions(make):
    root = make(*[f"{a}/{b}/{c}" for a in "pqr" for b in "xyz" for c in "123"])
    planned = [f for p in reader(root).partitions() for f in p.folders]
    assert len(planned) == 1 + 3 + 9
    assert sorted(f for f, deep in planned if deep) == [f"{a}/{b}" for a in "pqr" for b in "xyz"]
    assert len(reader(root, partitions="4").partitions()) == 4
    assert [p.folders for p in reader(root, recursive="false").partitions()] == [[("", False)]]


def test_pruned_folders_are_not_listed(make, monkeypatch):
    root = make(*NAMES)
    listed = []
    kept = TreeReader._entries
    monkeypatch.setattr(TreeReader, "_entries", lambda self, folder: listed.append(folder) or kept(self, folder))

    def walk(prefix=None, **options):
        listed.clear()
        r = reader(root, splitDepth="1", **options)
        if prefix is not None:
            assert list(r.pushFilters([tree_source.StringStartsWith(("rel_path",), prefix)]))
        for p in r.partitions():
            list(r.read(p))
        return set(listed)

    assert walk() == {"", "sub", "sub/deep", "sub/deep/er", "x", "mine", "é ü%"}
    assert walk(ignore="sub") == {"", "x", "mine", "é ü%"}
    assert walk("sub/deep/e") == {"", "sub", "sub/deep", "sub/deep/er"}
    assert walk("su") == {"", "sub", "sub/deep", "sub/deep/er"}
    assert walk("subway") == {""}


def test_a_prefix_filter_reaches_the_source(spark, make, tree):
    root = make(*NAMES)
    found = tree(root).filter(F.col("rel_path").startswith("sub/deep"))
    assert sorted(r.rel_path for r in found.collect()) == ["sub/deep/c.txt", "sub/deep/er/d"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        found = tree(root, pushdown="false").filter(F.col("rel_path").startswith("sub/deep"))
        assert sorted(r.rel_path for r in found.collect()) == ["sub/deep/c.txt", "sub/deep/er/d"]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_missing_roots_are_errors(make, tree, tmp_path):
    root = make("f")
    for path in (f"{tmp_path}/does/not", f"{root}/f", "zz9://bucket/x"):
        with pytest.raises(PySparkException):
            tree(path).collect()


def test_object_store(make, monkeypatch):
    """A store that is no mounted folder: here a subtree under a name of its own."""
    root = make(*NAMES)
    monkeypatch.setattr(stores, "_store", lambda scheme, bucket: (fs.SubTreeFileSystem(root, fs.LocalFileSystem()), ""))
    r = reader("s3a://bucket/")
    rows = sorted(row["rel_path"] for p in r.partitions() for batch in r.read(p) for row in batch.to_pylist())
    assert rows == sorted(["a.txt", "sub/b.PDF", "sub/deep/c.txt", "sub/deep/er/d", "mine/z", "é ü%/f"])
    some = [row for p in r.partitions() for batch in r.read(p) for row in batch.to_pylist() if row["name"] == "b.PDF"]
    assert some[0]["path"] == "s3a://bucket/sub/b.PDF" and some[0]["extension"] == "pdf" and some[0]["size"] == 4
    with pytest.raises(FileNotFoundError):
        reader("s3a://bucket/none").partitions()
