"""Moving files into category folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.functions.names import base_name, components, extension, scan_key
from stowline.operators.classify import with_category
from stowline.operators.moves import operations_of, resolve_moves, with_status
from stowline.settings import CATEGORIES, QUARANTINE, SOURCE_GONE

ORDER = ["scan_key", "source_path"]


def plan_moves(files: DataFrame, root: str, include_subfolders: bool = False,
               protected_paths: list[str] = ()) -> DataFrame:
    """(source_path, destination_path, category, scan_key) of the files to move.

    Protected paths match anywhere in a path, in any case. The category and
    quarantine folders are looked for in the whole path, above the root too.
    Narrow work only; ``scan_key`` gives the order without a sort.
    """
    for protected in protected_paths:
        files = files.filter(~F.lower("path").contains(protected.lower()))
    parts = components(F.col("path"))
    if not include_subfolders:
        files = files.filter(~F.exists(parts, lambda part: part.isin(CATEGORIES)))
    files = files.filter(~F.array_contains(parts, QUARANTINE))

    name = base_name(F.col("path"))
    named = files.select("path", scan_key(F.col("rel_path")).alias("scan_key"),
                         name.alias("name"), extension(name).alias("extension"))
    return (with_category(named)
            .select(F.col("path").alias("source_path"),
                    F.concat_ws("/", F.lit(root), "category", "name").alias("destination_path"),
                    "category", "scan_key")
            .filter("source_path != destination_path"))


def execute_plan(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The plan plus ``final_path``, ``status``, ``error_message``.

    ``files`` is the inventory at this moment; it decides which sources and
    names exist. A file listed twice (itself and a link to it) is moved once;
    its second move fails.
    """
    return with_status(resolve_moves(plan, files, ORDER, sources_unique=False), SOURCE_GONE)


def organize_operations(outcome: DataFrame) -> DataFrame:
    """Log rows of an executed plan, with the plan's order columns."""
    return operations_of(outcome.drop("category"), "ORGANIZE", ["scan_key"])
