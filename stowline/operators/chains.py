"""Moves of one batch that follow each other.

Moves are carried out in order. Whether a move finds its source, and whether its
destination is free, depends on the moves before it. After an attempt to
move away from a path, nothing is there, found or not; so a file that arrives
somewhere is taken on by the next move away from there, and by that one alone.
Each move has one successor at most, which makes chains, and chains of
any length are followed by pointer doubling: each round doubles the length of
the step, so ``log2`` of the longest chain rounds are enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline import settings
from stowline.operators.matching import keep_matching
from stowline.operators.ordinal import number_within
from stowline.sources.staging import measures_of, most_rows, stage


#: Following chains takes fewer joins than this, for any number of moves.
JOINS = 128


def _small(table: DataFrame) -> DataFrame:
    """``table`` (staged) with a broadcast hint if its counted rows are few, else one for a shuffle.

    What all rounds broadcast adds up on the driver, so each may have its part of the
    limit. Without a hint Spark would broadcast any table that looks small in bytes, round after round.
    """
    few = most_rows(table) <= settings.broadcast_rows(table.sparkSession) // JOINS
    return F.broadcast(table) if few else table.hint("merge")


def successors(departures: DataFrame, arrivals: DataFrame) -> DataFrame | None:
    """(move, next): for each arrival the next departure from the same path; staged, None if there is none.

    Both have (path, move), ``move`` being the unique place in the batch. Places
    in a path's order are found by row numbers and matched by equality, so
    that a path of very many moves is not one task.
    """
    shared = stage(keep_matching(arrivals, departures, ["path"]), "arrivals")
    if not most_rows(shared):
        return None
    leaving = stage(keep_matching(departures, shared, ["path"], most_rows(shared)), "departures")
    both = most_rows(shared) + most_rows(leaving)
    nth = number_within(shared, ["path"], ["move"], "_nth", at_most=most_rows(shared))
    events = number_within(nth.unionByName(leaving, allowMissingColumns=True), ["path"], ["move"], "_pos", at_most=both)
    turn = events.filter("_nth is not null").select("path", "move", (F.col("_pos") - F.col("_nth") + 1).alias("_turn"))
    turns = number_within(leaving, ["path"], ["move"], "_turn", at_most=most_rows(leaving)).select(
        "path", "_turn", F.col("move").alias("next"))
    found = stage(turn.join(turns, ["path", "_turn"]).select("move", "next"), "successors")
    return found if most_rows(found) else None


def _doubled(steps: DataFrame) -> DataFrame:
    onward = _small(steps).select(F.col("move").alias("next"), F.col("next").alias("_on"))
    return stage(steps.join(onward, "next").select("move", F.col("_on").alias("next")), "steps")


def reached(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(move) of ``start`` and all that follow them; staged."""
    found = stage(start.select("move"), "reached")
    while most_rows(steps):
        # A move that many lead to is named many times; the names are combined before they are shuffled.
        more = steps.join(_small(found), "move", "left_semi").select(F.col("next").alias("move"))
        found = stage(found.union(more).distinct(), "reached")
        steps = _doubled(steps)
    return found


def ends(steps: DataFrame) -> DataFrame:
    """(move, last) of every move that has a successor."""
    last = stage(steps.select("move", F.col("next").alias("last")), "ends")
    while True:
        onward = _small(last).select(F.col("move").alias("last"), F.col("last").alias("_on"))
        last = stage(last.select("move", "last").join(onward, "last", "left").select(
            "move", F.coalesce("_on", "last").alias("last"), F.col("_on").isNotNull().alias("_went")),
            "ends", went=F.count_if("_went"))
        if not measures_of(last)["went"]:
            return last.select("move", "last")


def arrivals_into_vacated(departures: DataFrame, arrivals: DataFrame) -> DataFrame | None:
    """(move) of arrivals at a path that the batch has just vacated: the event before is a departure.

    Staged; None if there is none.
    """
    shared = stage(keep_matching(arrivals, departures, ["path"]), "arrivals")
    if not most_rows(shared):
        return None
    leaving = keep_matching(departures, shared, ["path"], most_rows(shared))
    events = stage(number_within(shared.withColumn("_leaves", F.lit(False)).unionByName(
        leaving.withColumn("_leaves", F.lit(True))), ["path"], ["move"], "_pos"), "events")
    before = events.filter("_leaves").select("path", (F.col("_pos") + 1).alias("_pos"))
    found = stage(events.filter("not _leaves").join(before, ["path", "_pos"], "left_semi").select("move"), "vacated")
    return found if most_rows(found) else None


def settled(outcome: DataFrame, order: str) -> DataFrame:
    """(source_path, final_path): where each moved file was before the batch and where it is after it.

    ``outcome`` has source_path, destination_path, final_path (null if the
    source was not found) and the unique ``order``. A file stays
    where it got a numbered name.
    """
    done = stage(outcome.filter("final_path is not null").select(
        F.col(order).alias("move"), "source_path", "destination_path", "final_path"), "done")
    steps = successors(done.select(F.col("source_path").alias("path"), "move"),
                       done.filter("final_path = destination_path").select(F.col("final_path").alias("path"), "move"))
    if steps is None:
        return done.select("source_path", "final_path")
    heads = done.join(_small(steps).select(F.col("next").alias("move")), "move", "left_anti")
    last = ends(steps)
    finals = done.select(F.col("move").alias("_last"), F.col("final_path").alias("_final"))
    found = heads.join(last, "move", "left").withColumn("_last", F.coalesce("last", "move")).drop("last")
    return found.join(finals, "_last").select("source_path", F.col("_final").alias("final_path"))
