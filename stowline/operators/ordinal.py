"""Row numbers that never put a large group, or the whole of a large table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowline import settings
from stowline.sources.staging import measures_of, most_rows, stage

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def with_ordinal(df: DataFrame, order: list[Column | str], out: str,
                 at_most: int | None = None) -> DataFrame:
    """``df`` plus its 1-based position in the whole table under ``order``.

    ``order`` must be total for the numbers to be repeatable. ``at_most`` bounds
    the rows when the caller knows; a table known to be small is numbered in one
    task.
    """
    if _fits_a_task(df, at_most):
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return _number_by_range(df, [], order, out, at_most if at_most is not None else most_rows(df))


def hot_keys(df: DataFrame, keys: list[str], at_most: int | None = None) -> DataFrame | None:
    """Keys of groups too large for one task, with sizes; None when there are none.

    Counting combines before the shuffle. Each hot key stands for more than
    ``hot_rows`` rows, so there are at most rows / hot_rows of them and they are
    broadcast.
    """
    if _fits_a_task(df, at_most):
        return None
    limit = settings.hot_rows(df.sparkSession)
    hot = stage(df.groupBy(*keys).agg(F.count("*").alias("_hot_n"))
                .filter(F.col("_hot_n") > limit), "hot", members=F.sum("_hot_n"))
    return hot if most_rows(hot) else None


def number_within(df: DataFrame, keys: list[str], order: list[Column | str], out: str,
                  count_as: str | None = None, at_most: int | None = None) -> DataFrame:
    """``df`` plus the 1-based position of each row in its group, and the group's size.

    Ordinary groups take one window. Hot groups are sorted by range over many
    tasks.
    """
    hot = hot_keys(df, keys, at_most)
    if hot is None:
        return _number_by_window(df, keys, order, out, count_as)
    small = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    large = _number_by_range(df.join(F.broadcast(hot), keys), keys, order, out,
                             measures_of(hot)["members"])
    if count_as:
        large = large.withColumn(count_as, F.col("_hot_n"))
    return _number_by_window(small, keys, order, out, count_as).unionByName(large.drop("_hot_n"))


def _fits_a_task(df: DataFrame, at_most: int | None) -> bool:
    bound = at_most if at_most is not None else most_rows(df)
    return bound is not None and bound <= settings.hot_rows(df.sparkSession)


def _number_by_window(df, keys, order, out, count_as):
    group = Window.partitionBy(*keys)
    extra = {out: F.row_number().over(group.orderBy(*order)).cast("bigint")}
    if count_as:
        extra[count_as] = F.count("*").over(group)
    return df.withColumns(extra)


def _number_by_range(df, keys, order, out, rows):
    """Sort by range into a staged table, count each part, add what comes before.

    Parts are as many as the session shuffles into, or more when ``rows`` would
    overfill them; rows of an unknown number are staged and counted first, which also
    saves the range boundaries a second computation of ``df``.

    ``tallies`` holds one row per part, plus one for each further group that
    starts in it; groups are hot or there is only one, so it is small.
    """
    by = [*keys, *order]
    spark = df.sparkSession
    if rows is None:
        df = stage(df, "unordered")
        rows = most_rows(df)
    parts = -(-rows // settings.PART_ROWS)
    many = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        df.repartitionByRange(*([parts] if many else []), *by).sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_part", F.shiftright("_at", _PART_BITS))
    earlier = (Window.partitionBy(*keys).orderBy("_part")
               .rowsBetween(Window.unboundedPreceding, -1))
    tallies = (placed.groupBy(*keys, "_part")
               .agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
               .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
               .drop("_rows"))
    return (placed.join(F.broadcast(tallies), [*keys, "_part"])
            .withColumn(out, F.col("_at") - F.col("_first") + F.col("_before") + 1)
            .drop("_at", "_part", "_first", "_before"))
