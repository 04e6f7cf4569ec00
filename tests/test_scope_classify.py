import pytest

from stowline.operators.classify import category_table, with_category
from stowline.operators.scope import in_scope
from stowline.settings import CATEGORIES, IGNORED_NAMES
from stowline.sources.inventory import file_record, one_row_per_path, read_inventory


def scoped(inventory, paths, **options):
    return sorted(r.rel_path for r in in_scope(inventory([(p, "") for p in paths]), **options).collect())


def test_depth(inventory):
    paths = ["a.txt", "sub/b.txt", "sub/deep/c.txt"]
    assert scoped(inventory, paths) == paths
    assert scoped(inventory, paths, recursive=False) == ["a.txt"]
    assert scoped(inventory, []) == []


def test_hidden(inventory):
    paths = [".secret", "visible.txt", "a/.b/c", "a/.d", "a.b/c"]
    assert scoped(inventory, paths) == ["a.b/c", "visible.txt"]
    assert scoped(inventory, [*paths, ".git/x"], include_hidden=True) == sorted(paths)


def test_ignored_names_hide_folders_and_files(inventory):
    paths = ["Documents/inside.pdf", "x/__pycache__/cache.pyc", "visible.txt", "x/data", "logs",
             "documents/a", "Documents2/b", "mine/c"]
    assert scoped(inventory, paths) == ["Documents2/b", "documents/a", "mine/c", "visible.txt"]
    assert scoped(inventory, paths, ignore=["mine", "Documents2"]) == ["documents/a", "visible.txt"]


def test_fixed_values(spark):
    table = category_table(spark).collect()
    sizes = [sum(r.category == c for r in table) for c in CATEGORIES]
    assert sizes == [13, 10, 11, 9, 10, 10, 32, 5, 4, 0]
    assert len({r.extension for r in table}) == 104
    assert len(set(IGNORED_NAMES)) == 18


@pytest.mark.parametrize("category, names", [
    ("Images", "photo.jpg image.png pic.gif art.webp photo.JPG"),
    ("Documents", "report.pdf notes.txt letter.doc doc.docx REPORT.PDF"),
    ("Audio", "Song.MP3 song.wav"), ("Videos", "clip.mp4"), ("Archives", "bundle.zip a.tar.gz"),
    ("Programs", "installer.exe"), ("Code", "script.py"), ("Spreadsheets", "table.xlsx"),
    ("Presentations", "slides.pptx"), ("Other", "file.xyz mystery archive.tar.unknown README .jpg a."),
])
def test_categories(inventory, category, names):
    files = file_record(inventory([(f"d/{n}", "") for n in names.split()]))
    assert {r.category for r in with_category(files).collect()} == {category}


def test_read_inventory_reads_only_the_mapped_columns(spark, tmp_path):
    spark.range(5).selectExpr("concat('/lake/', id) key", "id bytes", "'x' unused").write.csv(
        str(tmp_path / "m"), header=True)
    files = read_inventory(spark, str(tmp_path / "m"), {"path": "key", "size": "cast(bytes as bigint)"},
                           format="csv", header="true")
    assert files.columns == ["path", "size"]
    assert sorted((r.path, r.size) for r in files.collect())[1] == ("/lake/1", 1)


def test_one_row_per_path(spark):
    rows = [("/r/t", "t", "t", 3), ("/r/t", "a-link", "a-link", 3), ("/r/u", "u", "u", 1)]
    files = spark.createDataFrame(rows, "path string, rel_path string, name string, size long")
    assert sorted((r.path, r.name) for r in one_row_per_path(files).collect()) == [
        ("/r/t", "a-link"), ("/r/u", "u")]
