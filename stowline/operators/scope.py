"""Which listed files count: ignored names, hidden names, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.functions.names import components
from stowline.settings import IGNORED_NAMES


def without_ignored(files: DataFrame, extra: list[str] = ()) -> DataFrame:
    """No component under the root, the file's own name included, is an ignored name."""
    names = list(dict.fromkeys([*IGNORED_NAMES, *extra]))
    return files.filter(~F.exists(components(F.col("rel_path")), lambda part: part.isin(names)))


def without_hidden(files: DataFrame) -> DataFrame:
    hidden = F.col("rel_path").startswith(".") | F.col("rel_path").contains("/.")
    return files.filter(~hidden)


def direct_children(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("rel_path").contains("/"))


def in_scope(files: DataFrame, recursive: bool = True, include_hidden: bool = False,
             ignore: list[str] = ()) -> DataFrame:
    files = without_ignored(files, ignore)
    if not include_hidden:
        files = without_hidden(files)
    return files if recursive else direct_children(files)
