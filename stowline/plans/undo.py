"""Reversing the latest batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.operators.chains import settled
from stowline.operators.moves import operations_of, resolve_moves, with_status
from stowline.operators.ordinal import with_ordinal
from stowline.settings import FILE_MISSING, REVERSIBLE_TYPES
from stowline.sources.oplog import batch_operations

ORDER = ["undo_seq"]


def reverse_operations(log: DataFrame, batch_id: str | None) -> DataFrame:
    """(undo_seq, current_path, original_path): what to move back, last operation first."""
    done = batch_operations(log, batch_id).filter(
        (F.col("status") == "SUCCESS") & F.col("operation_type").isin(REVERSIBLE_TYPES)
        & (F.col("source_path") != F.col("destination_path")))
    rows = done.select("id", F.col("destination_path").alias("current_path"),
                       F.col("source_path").alias("original_path"))
    return with_ordinal(rows, [F.desc("id")], "undo_seq").select(
        "undo_seq", "current_path", "original_path")


def execute_undo(reverse: DataFrame, files: DataFrame) -> DataFrame:
    """Moves back with ``final_path``, ``status``, ``error_message``.

    Steps follow each other: after ``A -> B`` and ``B -> C``, the file at C
    goes back to B and on to A. A log may name one file twice; the second attempt
    no longer finds it.
    """
    moves = reverse.select("undo_seq", F.col("current_path").alias("source_path"),
                           F.col("original_path").alias("destination_path"))
    return with_status(resolve_moves(moves, files, ORDER, sources_unique=False, chained=True),
                       FILE_MISSING)


def restored_files(outcome: DataFrame) -> DataFrame:
    """(source_path, final_path) of each file that the undo moved, for the state after it."""
    return settled(outcome, ORDER[0])


def undo_operations(outcome: DataFrame) -> DataFrame:
    return operations_of(outcome, "UNDO", ORDER)


def undo_summary(outcome: DataFrame) -> DataFrame:
    """One row: restored, failed, and whether the undo failed as a whole."""
    restored, failed = (F.count_if(F.col("status") == s) for s in ("SUCCESS", "FAILED"))
    return outcome.agg(restored.alias("restored"), failed.alias("failed"),
                       ((failed > 0) & (restored == 0)).alias("all_failed"))
