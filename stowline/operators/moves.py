"""Carrying out moves on tables: what is there, under which name, and what remains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline import settings
from stowline.functions.names import base_name, extension, parent_dir
from stowline.operators.chains import arrivals_into_vacated, reached, successors
from stowline.operators.matching import keep_matching
from stowline.operators.naming import unique_names
from stowline.operators.ordinal import number_within
from stowline.sources.positions import at_positions
from stowline.sources.staging import most_rows, stage


def resolve_moves(moves: DataFrame, present: DataFrame, order: list[str],
                  sources_unique: bool = True, chained: bool = False) -> DataFrame:
    """``moves`` (source_path, destination_path, order...) plus ``final_path``; staged.

    ``final_path`` is null where the source is not in ``present`` (path); such
    moves use up no name. Names are free if neither ``present`` nor an earlier
    move of this batch has them. When sources may repeat, only the first move
    of a source finds it.

    With ``chained``, moves follow each other: a move also finds what an
    earlier one brought to its source, and a name that an earlier one
    vacated is free, unless it would be a numbered one. ``order`` is one unique
    column then. A numbered name given out is not looked for as a source.
    """
    moves = stage(moves, "moves")
    total = most_rows(moves)
    there = present.select("path")
    if total <= settings.broadcast_rows(moves.sparkSession):
        # A few moves need a few rows of the inventory, found without shuffling it.
        there = keep_matching(there, moves.select(F.col("source_path").alias("path")), ["path"], total)
    found = there.filter(F.col("path") == F.col("source_path").outer()).exists()
    checked = moves.select("*", found.alias("_found"))
    if not sources_unique:
        checked = number_within(checked, ["source_path"], order, "_turn", at_most=total).withColumn(
            "_found", F.col("_found") & (F.col("_turn") == 1)).drop("_turn")
    checked = stage(checked, "checked")
    freed = None
    if chained:
        checked, freed = _follow(checked, order[0])

    target = F.col("destination_path")
    requests = checked.filter("_found").drop("_found")
    if freed is not None:
        requests = stage(requests.join(freed, order, "left_anti"), "requests")
    requests = requests.withColumns(
        {"directory": parent_dir(target), "name": base_name(target)})
    folders = requests.select(F.col("directory"))
    occupied = keep_matching(
        present.select(parent_dir(F.col("path")).alias("directory"),
                       base_name(F.col("path")).alias("name")), folders, ["directory"], total)
    named = unique_names(requests, occupied, order, total).withColumn(
        "final_path", F.concat_ws("/", "directory", "final_name")).select(*moves.columns, "final_path")
    lost = checked.filter("not _found").drop("_found").withColumn(
        "final_path", F.lit(None).cast("string"))
    if freed is not None:
        back = checked.filter("_found").drop("_found").join(freed, order, "left_semi")
        lost = lost.unionByName(back.withColumn("final_path", target))
    return stage(named.unionByName(lost), "resolved")


def _follow(checked: DataFrame, order: str) -> tuple[DataFrame, DataFrame | None]:
    """``checked`` with ``_found`` along chains, and the moves into names that their batch vacated."""
    leaving = checked.select(F.col("source_path").alias("path"), F.col(order).alias("move"))
    going = checked.select(F.col("destination_path").alias("path"), F.col(order).alias("move"))
    steps = successors(leaving, going)
    if steps is not None:
        found = reached(checked.filter("_found").select(F.col(order).alias("move")), steps)
        checked = stage(checked.drop("_found").join(found.select(F.col("move").alias(order), F.lit(True).alias("_f")), order, "left")
                        .select(*checked.drop("_found").columns, F.col("_f").isNotNull().alias("_found")), "checked")
    done = checked.filter("_found")
    freed = arrivals_into_vacated(done.select(F.col("source_path").alias("path"), F.col(order).alias("move")),
                                  done.select(F.col("destination_path").alias("path"), F.col(order).alias("move")))
    return checked, None if freed is None else freed.select(F.col("move").alias(order))


def with_status(resolved: DataFrame, error: str) -> DataFrame:
    """``status`` and ``error_message`` of resolved moves."""
    gone = F.col("final_path").isNull()
    return resolved.withColumns({
        "status": F.when(gone, "FAILED").otherwise("SUCCESS"),
        "error_message": F.when(gone, F.lit(error)),
    })


def operations_of(outcome: DataFrame, operation_type: str, order: list[str]) -> DataFrame:
    """Log rows; a failed move records the destination that was planned."""
    return outcome.select(
        F.lit(operation_type).alias("operation_type"), "source_path",
        F.coalesce("final_path", "destination_path").alias("destination_path"),
        "status", "error_message", *order)


def apply_moves(files: DataFrame, resolved: DataFrame, root: str | None = None) -> DataFrame:
    """``files`` after the moves: ``path``, ``name`` and ``extension`` are the new ones.

    With ``root``, ``rel_path`` of moved files is their new path below it (the
    whole path if it lies elsewhere), so that the next scan sees where they are.
    ``resolved`` has at most one successful move per source. Contents are not
    shuffled if the moves can be broadcast or ``files`` is a scan of Parquet
    files, whose rows are then told by file and position.
    """
    done = resolved.filter("final_path is not null").select(
        F.col("source_path").alias("path"), F.col("final_path").alias("_new"))
    name = base_name(F.coalesce("_new", "path"))
    renewed = {}
    if root is not None and "rel_path" in files.columns:
        below = root.rstrip("/") + "/"
        renewed["rel_path"] = F.when(F.col("_new").isNull(), F.col("rel_path")).when(
            F.startswith("_new", F.lit(below)), F.substr("_new", F.lit(len(below) + 1))).otherwise(F.col("_new"))
    changed = _with_new_paths(files, done)
    return changed.withColumns(renewed).withColumns({
        "name": name, "extension": extension(name),
        "path": F.coalesce("_new", "path")}).drop("_new").select(
            *dict.fromkeys([*files.columns, "name", "extension"]))


def _with_new_paths(files: DataFrame, done: DataFrame) -> DataFrame:
    """``files`` plus ``_new``, without a shuffle of contents where that can be had."""
    spark = files.sparkSession
    if "content" not in files.columns:
        return files.join(done, "path", "left")
    done = stage(done, "done")
    if most_rows(done) <= settings.broadcast_rows(spark):
        return files.join(F.broadcast(done), "path", "left")
    found = at_positions(files, done, "path")
    return files.join(done, "path", "left") if found is None else found
