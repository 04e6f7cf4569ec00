"""Counters that run along sorted rows and rise by one at a row that exceeds them.

A row with threshold ``c`` keeps what it has if the counter ``g`` is at least ``c``,
else it loses it and the counter rises: ``f(g) = g + 1 if g < c else g``. Along many rows
these functions compose to ``F(g) = g + (number of breakpoints at or above g)``, with distinct
breakpoints. So a range of rows can be summed up without its incoming counter, and
a long group is cut into ranges whose functions are chained.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.sources.staging import most_rows, stage

#: Rows of a group summed up in one function.
RANGE_ROWS = 50_000


def add_step(breakpoints: list[int], threshold: int) -> None:
    """Follow the function that ``breakpoints`` (ascending) stand for by a row's; counters are -1 or more."""
    m = len(breakpoints)
    # The counter is g + m - j where j breakpoints lie below g: find the last such stretch that begins under the threshold.
    low, high = 0, m
    while low < high:
        j = (low + high + 1) // 2
        if breakpoints[j - 1] + 1 + m - j < threshold:
            low = j
        else:
            high = j - 1
    last = threshold - 1 - m + low
    if low < m:
        last = min(last, breakpoints[low])
    if last >= -1:
        insort(breakpoints, last)


def after_steps(breakpoints: list[int], counter: int) -> int:
    return counter + len(breakpoints) - bisect_left(breakpoints, counter)


def lost_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` (keys, order, threshold, counter, ...) plus ``lost``, in each group of ``keys``; staged.

    ``counter`` is the group's at its beginning. Groups longer than a range go through
    several tasks; only one function for each range, one after the other, passes
    through a single one.
    """
    parts = -(-(most_rows(rows) or 0) // RANGE_ROWS)
    by = [*keys, order]
    if parts <= 1:
        whole = rows.withColumns({"_part": F.lit(0), "_in": F.lit(None).cast("long")}).repartition(1)
        return _played(whole, keys, by)
    placed = stage(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranges")
    # At most one group for each boundary between parts.
    spanning = stage(placed.groupBy(*keys).agg(F.min("_part").alias("_a"), F.max("_part").alias("_b")).filter(
        "_a < _b").select(*keys), "spanning")
    entering = _entering(placed.join(F.broadcast(spanning), keys, "left_semi"), keys, by)
    own = placed.join(F.broadcast(entering), [*keys, "_part"], "left").repartition("_part")
    return _played(own, keys, by)


def _played(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    names = [c for c in rows.columns if c not in ("_part", "_in")]
    at = {c: rows.columns.index(c) for c in (*keys, "_part", "threshold", "counter", "_in")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, g = None, 0
        for batch in batches:
            columns = {c: batch.column(i).to_pylist() for c, i in at.items()}
            lost = []
            for threshold, counter, entered, *key in zip(columns["threshold"], columns["counter"], columns["_in"],
                                                         columns["_part"], *(columns[k] for k in keys), strict=True):
                if key != now:
                    now, g = key, counter if entered is None else entered
                lost.append(threshold > g)
                g += lost[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lost, pa.bool_())], [*names, "lost"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c in names) + ", lost boolean"
    return stage(rows.sortWithinPartitions("_part", *by).mapInArrow(run, schema), "played")


def _entering(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(keys, _part, _in): the counter with which each part goes on with a group; staged, a row for each range."""
    kinds = dict(rows.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, breakpoints = None, 0, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([v]) for v in now[1:]), pa.array([now[0]], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([breakpoints], pa.list_(pa.int64()))], [*keys, "_part", "counter", "breakpoints"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("threshold", "counter", "_part", *keys)]
            for threshold, counter, *key in zip(*columns, strict=True):
                if key != now:
                    if now is not None:
                        yield row()
                    now, start, breakpoints = key, counter, []
                add_step(breakpoints, threshold)
        if now is not None:
            yield row()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, g = None, 0
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                key = [one.column(k)[0].as_py() for k in keys]
                if key != now:
                    now, g = key, one.column("counter")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(k) for k in keys), one.column("_part"), pa.array([g], pa.int64())], [*keys, "_part", "_in"])
                g = after_steps(one.column("breakpoints")[0].as_py(), g)

    functions = stage(rows.select(*by, "threshold", "counter", "_part").repartition("_part").sortWithinPartitions(
        "_part", *by).mapInArrow(sum_up, f"{head}, _part int, counter long, breakpoints array<long>"), "functions")
    return stage(functions.repartition(1).sortWithinPartitions(*keys, "_part").mapInArrow(
        chain, f"{head}, _part int, _in long"), "entering")
