"""Reports as tables of lines.

Short reports have ``line_no``. Long ones have the columns that order them
instead, so that no global numbering is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.functions.names import base_name, scan_key
from stowline.functions.sizes import human_size
from stowline.functions.times import iso_utc
from stowline.operators.duplicates import join_groups
from stowline import settings
from stowline.operators.ordinal import with_ordinal
from stowline.settings import LISTED_PATHS, PREVIEW_MOVES, RECENT_OPERATIONS
from stowline.sources.oplog import recent


def _line(position: Column | int, text: Column | str) -> Column:
    position = F.lit(position).cast("bigint") if isinstance(position, int) else position.cast("bigint")
    return F.struct(position.alias("line_no"),
                    (F.lit(text) if isinstance(text, str) else text).alias("line"))


def _lines(rows: DataFrame, *lines: Column) -> DataFrame:
    """One output row per given line and input row, null lines left out."""
    return (rows.select(F.explode(F.array(*lines)).alias("_l")).select("_l.*")
            .filter("line is not null"))


def _top(rows: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The first rows with their number ``n``."""
    if limit <= settings.hot_rows(rows.sparkSession):
        return with_ordinal(rows.orderBy(*order).limit(limit), order, "n", at_most=limit)
    return with_ordinal(rows, order, "n").filter(F.col("n") <= limit)


def _more(total: Column, shown: int, indent: str) -> Column:
    return F.when(total > shown, F.format_string(f"{indent}... and %d more.", total - shown))


def scan_listing(files: DataFrame, root: str, limit: int = LISTED_PATHS) -> DataFrame:
    total = files.agg(F.count("*").alias("total"))
    head = _lines(total, _line(1, f"Scanned directory: {root}"),
                  _line(2, F.format_string("Found %d file(s).", "total")), _line(3, ""),
                  _line(limit + 4, _more(F.col("total"), limit, "  ")))
    shown = _top(files.select("path", scan_key(F.col("rel_path")).alias("k")), ["k", "path"], limit)
    listed = _lines(shown, _line(F.col("n") + 3, F.concat(F.lit("  "), "path")))
    return head.unionByName(listed)


def plan_preview(plan: DataFrame, limit: int = PREVIEW_MOVES) -> DataFrame:
    total = plan.agg(F.count("*").alias("total"))
    more = _more(F.col("total"), limit, "")
    foot = F.least("total", F.lit(limit)) * 4 + 3
    frame = _lines(total, _line(1, "Planned operations:"), _line(2, ""), _line(foot, more),
                   _line(foot + 1, F.when(more.isNotNull(), "")),
                   _line(foot + F.when(more.isNotNull(), 2).otherwise(0),
                         F.format_string("Total files to move: %d", "total")))
    shown = _top(plan, ["scan_key", "source_path"], limit)
    first = F.col("n") * 4 - 1
    listed = _lines(
        shown,
        _line(first, F.format_string("%d. %s", "n", base_name(F.col("source_path")))),
        _line(first + 1, F.concat(F.lit("   From: "), "source_path")),
        _line(first + 2, F.concat(F.lit("   To:   "), "destination_path")),
        _line(first + 3, ""))
    return frame.unionByName(listed)


def undo_preview(reverse: DataFrame) -> DataFrame:
    """Ordered by ``undo_seq`` and ``line_no``; the frame has 0 and the highest number."""
    steps = reverse.select("undo_seq", F.explode(F.array(
        _line(1, F.format_string("%d. Move:", "undo_seq")),
        _line(2, F.concat(F.lit("   "), "current_path")), _line(3, ""),
        _line(4, "   Back to:"), _line(5, F.concat(F.lit("   "), "original_path")),
        _line(6, ""))).alias("_l")).select("undo_seq", "_l.*")
    total = reverse.agg(F.count("*").alias("n"))
    head = _lines(total, _line(1, "Undo preview:"), _line(2, "")).withColumn(
        "undo_seq", F.lit(0).cast("bigint"))
    foot = total.select((F.col("n") + 1).alias("undo_seq"), F.lit(1).cast("bigint").alias("line_no"),
                        F.format_string("Total files to restore: %d", "n").alias("line"))
    return reduce(DataFrame.unionByName, [head, steps, foot])


def duplicates_report(members: DataFrame, groups: DataFrame, root: str) -> DataFrame:
    """Ordered by ``group_no``, ``part``, ``member_no``, ``line_no``.

    ``groups`` is numbered. Group 0 is the heading; parts are the group's
    heading, its files, its closing lines.
    """
    def block(rows: DataFrame, part: int, member_no: Column, *lines: Column) -> DataFrame:
        return rows.select("group_no", F.lit(part).alias("part"), member_no.alias("member_no"),
                           F.explode(F.array(*lines)).alias("_l")).select(
                               "group_no", "part", "member_no", "_l.*").filter("line is not null")

    none = F.lit(0).cast("bigint")
    total = groups.agg(F.count("*").alias("n")).withColumn("group_no", none)
    found = F.when(F.col("n") > 0, F.format_string("Found %d duplicate group(s).", "n")).otherwise(
        "No duplicate files found.")
    heading = block(total, 0, none, _line(1, f"Scanned: {root}"), _line(2, found),
                    _line(3, F.when(F.col("n") > 0, "")))
    opening = block(groups, 1, none,
                    _line(1, F.format_string("Duplicate group %d", "group_no")), _line(2, ""),
                    _line(3, F.concat(F.lit("Hash: "), "digest")), _line(4, ""),
                    _line(5, "Files:"))
    files = block(join_groups(members, groups.select("digest", "n_files", "group_no")), 2,
                  F.col("member_no"),
                  _line(1, F.format_string("%d. %s", "member_no", "path")),
                  _line(2, F.concat(F.lit("   Size: "), human_size(F.col("size")))))
    closing = block(groups, 3, none, _line(1, ""),
                    _line(2, F.concat(F.lit("Potential space that can be recovered: "),
                                      human_size(F.col("recoverable")))), _line(3, ""))
    return reduce(DataFrame.unionByName, [heading, opening, files, closing])


def history_lines(operations: DataFrame) -> DataFrame:
    """(id, line); the report shows them by id, highest first."""
    marker = F.when(F.col("status") == "SUCCESS", "+").otherwise("!")
    kind = F.when(F.length("operation_type") < 16, F.rpad("operation_type", 16, " ")).otherwise(
        F.col("operation_type"))
    return operations.select("id", F.concat(
        F.lit("["), marker, F.lit("] "), kind, F.lit(" "), iso_utc(F.col("timestamp")),
        F.lit("  "), "source_path", F.lit(" -> "), "destination_path").alias("line"))


def history_report(log: DataFrame, limit: int = RECENT_OPERATIONS) -> DataFrame:
    shown = history_lines(recent(log, limit))
    total = shown.agg(F.count("*").alias("n"))
    none = F.col("n") == 0
    head = _lines(total, _line(1, F.when(none, "No operations recorded yet.").otherwise("Recent operations:")),
                  _line(2, F.when(~none, "")))
    numbered = with_ordinal(shown, [F.desc("id")], "_n", at_most=limit)
    return head.unionByName(numbered.select((F.col("_n") + 2).alias("line_no"), "line"))


def summary_counts(**tables: DataFrame) -> DataFrame:
    """(metric, value): the row count of each table."""
    return reduce(DataFrame.unionByName, [
        t.agg(F.lit(m).alias("metric"), F.count("*").alias("value")) for m, t in tables.items()])
