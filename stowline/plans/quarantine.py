"""Moving all but one file of a duplicate group into the quarantine folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.functions.names import base_name
from stowline.operators.duplicates import groups_of, join_groups
from stowline.operators.moves import operations_of, resolve_moves
from stowline.settings import QUARANTINE

ORDER = ["size_down", "first_seen", "member_no"]
_BLANKS = r"(?U)^\s+|\s+$"


def parse_choice(choice: Column, count: Column) -> Column:
    """``s``, a member number as text, or null for anything else."""
    text = F.lower(F.regexp_replace(choice, _BLANKS, ""))
    digits = F.when(text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(text, F.lit("_"), F.lit("")))
    number = digits.try_cast("bigint")
    return F.when(text == "s", "s").when(number.between(1, count), number.cast("string"))


def read_decisions(decisions: DataFrame, groups: DataFrame) -> DataFrame:
    """(digest, choice, n_files, answer) of decisions on existing groups.

    A null ``answer`` is a rejected choice. Two decisions on one group are an
    error, not a choice between them.
    """
    only = decisions.groupBy("digest").agg(
        F.min("choice").alias("choice"), F.count("*").alias("_n"))
    only = only.withColumn("choice", F.when(F.col("_n") == 1, F.col("choice")).otherwise(
        F.raise_error(F.concat(F.lit("more than one decision on group "), "digest"))))
    return (only.drop("_n").join(groups.select("digest", "n_files"), "digest")
            .withColumn("answer", parse_choice(F.col("choice"), F.col("n_files"))))


def decide(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """``groups`` plus ``keep_no``: the member to keep, null to skip the group.

    A skip, a rejected choice and no decision at all leave the group alone.
    """
    answers = read_decisions(decisions, groups).select(
        "digest", F.col("answer").try_cast("bigint").alias("keep_no"))
    return groups.join(answers, "digest", "left")


def plan_review(members: DataFrame, decided: DataFrame, root: str) -> DataFrame:
    """Moves of all members but the keeper, in group and member order."""
    kept = decided.filter("keep_no is not null")
    return (join_groups(members, kept).filter("member_no != keep_no")
            .select(F.col("path").alias("source_path"),
                    F.concat_ws("/", F.lit(root), F.lit(QUARANTINE), base_name(F.col("path")))
                    .alias("destination_path"),
                    "digest", "member_no", (-F.col("size")).alias("size_down"), "first_seen"))


def execute_review(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The plan plus ``final_path``; moves whose source is gone are dropped, not failed."""
    return resolve_moves(plan, files, ORDER, sources_unique=False).filter("final_path is not null")


def review_operations(done: DataFrame) -> DataFrame:
    outcome = done.withColumns({"status": F.lit("SUCCESS"),
                                "error_message": F.lit(None).cast("string")})
    return operations_of(outcome, "DUPLICATE_REVIEW", ORDER)


def review_summary(decided: DataFrame, done: DataFrame) -> DataFrame:
    """One row: files moved, groups skipped."""
    moved = done.select(F.lit(1).alias("moved"), F.lit(0).alias("skipped"))
    skipped = decided.filter("keep_no is null").select(F.lit(0).alias("moved"), F.lit(1).alias("skipped"))
    return moved.unionByName(skipped).agg(
        F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))


def dry_run_summary(groups: DataFrame) -> DataFrame:
    """What a dry run reports: nothing moved, every group skipped."""
    return groups.agg(F.lit(0).cast("bigint").alias("moved"), F.count("*").alias("skipped"))
