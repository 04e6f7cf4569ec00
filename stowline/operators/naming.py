"""Conflict-free target names for a whole batch at once.

The rule is sequential: requests come in order, and each takes its name if that
is free, else the first free ``stem (k)suffix``. Call the name itself slot 0 of
its list and ``stem (k)suffix`` slot k. Requests for one name fill its free
slots in order, so with the occupied slots known, request r gets the r-th free
one. Merging requests and occupied slots by "free slots below me" puts each
request exactly at the position that is its slot number.

Two names interact only when one is a numbered form of the other and both are
requested: whoever comes first gets the shared slot. Only those names, one row
per distinct name, are settled in slot order, one round for each number of
counters; see :func:`_settle_shared`.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stowline import settings
from stowline.functions.names import COUNTERS, family, numbered, slots_of
from stowline.operators.matching import keep_matching
from stowline.operators.ordinal import number_within
from stowline.operators.steps import lost_rows
from stowline.sources.staging import measures_of, most_rows, stage

NAME = ["directory", "name"]
_SLOT = [*NAME, "_slot"]


def unique_names(requests: DataFrame, occupied: DataFrame, order: list[str],
                 most_requests: int | None = None) -> DataFrame:
    """``requests`` (directory, name, ...) plus ``final_name``.

    ``occupied`` has (directory, name) of what exists. ``order`` names columns
    of ``requests`` that order it totally. ``requests`` is read several times,
    so a costly one should be staged; ``most_requests`` bounds its rows when the
    caller knows.
    """
    asked = most_rows(requests) if most_requests is None else most_requests
    first = F.col("_rank") == 1
    ranked = stage(number_within(requests, NAME, order, "_rank", at_most=asked), "ranked",
                   names=F.count_if(first),
                   numbered=F.count_if(first & (F.size(slots_of(F.col("name"))) > 1)),
                   dotted=F.count_if(first & family(F.col("name")).endswith(".")))
    firsts = ranked.filter(first).select(*NAME, *order)
    found = measures_of(ranked)
    asked = most_rows(ranked)

    taken = stage(_requested_slots(occupied, firsts, found["names"]), "slots")
    pairs = tangled = None
    if found["numbered"]:
        pairs, tangled = _interacting(firsts, taken, found["dotted"] > 0)
    simple = ranked
    if tangled is not None:
        families = tangled.select("directory", "_family")
        simple = ranked.withColumn("_family", family(F.col("name"))).join(
            families, ["directory", "_family"], "left_anti").drop("_family")
    if pairs is not None:
        settled = _settle_shared(pairs, ranked, taken, order)
        taken = stage(taken.unionByName(settled).distinct(), "slots")

    result = _free_slots(simple, taken, asked).withColumn(
        "final_name", numbered(F.col("name"), F.col("_position") - 1)).drop("_position")
    if tangled is not None:
        result = result.unionByName(_one_by_one(requests, occupied, families, order))
    return result


def _requested_slots(occupied: DataFrame, firsts: DataFrame, names: int) -> DataFrame:
    """(directory, name, _slot) of existing names that fill a slot of a requested name."""
    slots = (occupied.select("directory", F.explode(slots_of(F.col("name"))).alias("_s"))
             .select("directory", F.col("_s.base").alias("name"), F.col("_s.slot").alias("_slot")))
    return keep_matching(slots, firsts, NAME, names).distinct()


def _free_slots(ranked: DataFrame, taken: DataFrame, asked: int) -> DataFrame:
    """``_position`` of each request among requests and taken slots of its name."""
    blocked = most_rows(taken)
    spared = None
    if blocked <= settings.broadcast_rows(ranked.sparkSession):
        # Names without a taken slot keep their rank and need no second shuffle.
        if not blocked:
            return ranked.withColumnRenamed("_rank", "_position")
        names = F.broadcast(taken.select(*NAME).distinct())
        spared = ranked.join(names, NAME, "left_anti").withColumnRenamed("_rank", "_position")
        ranked = ranked.join(names, NAME, "left_semi")
    lower = number_within(taken, NAME, ["_slot"], "_nth")
    marks = lower.select(*NAME, (F.col("_slot") - F.col("_nth") + 1).alias("_free_below"),
                         F.lit(False).alias("_asks"))
    asks = ranked.withColumns({"_free_below": F.col("_rank") - 1, "_asks": F.lit(True)}).drop("_rank")
    merged = asks.unionByName(marks, allowMissingColumns=True)
    placed = (number_within(merged, NAME, ["_free_below", "_asks"], "_position",
                            at_most=asked + blocked)
              .filter("_asks").drop("_asks", "_free_below"))
    return placed if spared is None else placed.unionByName(spared)


def _interacting(firsts: DataFrame, taken: DataFrame, dotted: bool):
    """(pairs, tangled): requested names whose base is requested too, and the odd rest.

    A pair is (directory, name, _slot, child, order...) with ``child`` the
    requested name that is slot ``_slot`` of ``name`` and does not exist yet.
    A name can have two bases only if its family ends in a dot (``y. (1)``);
    such families with several requested names are ``tangled``. Each is None
    when empty.
    """
    order = [c for c in firsts.columns if c not in NAME]
    family_of = family(F.col("name"))
    by_base = firsts.withColumn("_s", F.explode(F.slice(slots_of(F.col("name")), 2, 2))).select(
        "directory", F.col("_s.base").alias("name"), F.col("_s.slot").alias("_slot"),
        F.col("name").alias("child"), *order)
    existing = taken.filter("_slot = 0").select("directory", F.col("name").alias("child"))
    pairs = stage(by_base.filter(~family_of.endswith("."))
                  .join(firsts.select(*NAME), NAME, "left_semi")
                  .join(existing, ["directory", "child"], "left_anti"), "pairs")
    if not dotted:
        return pairs if most_rows(pairs) else None, None
    tangled = stage(firsts.withColumn("_family", family_of).filter(F.col("_family").endswith("."))
                    .groupBy("directory", "_family").agg(F.count("*").alias("_n"))
                    .filter("_n > 1"), "tangled")
    return tuple(t if most_rows(t) else None for t in (pairs, tangled))


def _settle_shared(pairs: DataFrame, ranked: DataFrame, taken: DataFrame,
                   order: list[str]) -> DataFrame:
    """Slots that the first come of a shared name takes away, as (directory, name, _slot).

    For a pair of base b and child c = slot k of b, let ``_asked`` be the
    requests for b before the first request for c and ``_free`` the slots of b
    below k that nothing existing fills. Slot k goes to c if b's requests had
    not reached it: if ``_asked`` is at most the free slots below k that other
    children leave to b. Otherwise b took it and c finds its own slot 0 filled.
    """
    base_requests = keep_matching(ranked.select(*NAME, *order), pairs, NAME, most_rows(pairs))
    base_taken = keep_matching(taken, pairs, NAME, most_rows(pairs))

    by_time = number_within(pairs, NAME, order, "_nth_asked")
    both = base_requests.unionByName(by_time, allowMissingColumns=True)
    n_pairs = most_rows(pairs)
    timed = (number_within(both, NAME, order, "_pos",
                           at_most=most_rows(ranked) + n_pairs)
             .filter("child is not null")
             .withColumn("_asked", F.col("_pos") - F.col("_nth_asked"))
             .drop("_pos", "_nth_asked", *order))

    by_slot = number_within(timed, NAME, ["_slot"], "_nth", at_most=n_pairs)
    both = base_taken.unionByName(by_slot, allowMissingColumns=True)
    pairs = (number_within(both, NAME, ["_slot"], "_pos", at_most=most_rows(taken) + n_pairs).filter("child is not null")
             .withColumn("_free", F.col("_slot") - (F.col("_pos") - F.col("_nth")))
             .drop("_pos"))
    # A base too late even if all other children took their slots has no say.
    clear = F.col("_asked") <= F.col("_free") - F.col("_nth")
    pairs = pairs.withColumns({"_clear": clear, "_level": F.regexp_count("name", F.lit(COUNTERS))})
    pairs = stage(pairs, "settling")
    return _contested(pairs.filter("not _clear")).unionByName(pairs.filter("_clear").select(*_SLOT))


def _contested(pairs: DataFrame) -> DataFrame:
    """Who gets each slot that is not clear, as (directory, name, _slot).

    Every child so far was counted as one free slot less for the base; each lost
    child gives one back, and a base that lost its own name has one less to begin
    with. Children have one counter more than their base, so one round for
    each number of counters settles all bases with that many at once.
    """
    pairs = stage(pairs.withColumn("threshold", F.col("_asked") - F.col("_free") + F.col("_nth") - 1).select(
        *_SLOT, "child", "threshold", "_level"), "contested")
    levels = [r[0] for r in pairs.select("_level").distinct().orderBy("_level").collect()]  # names are short
    settled, lost = [], None
    for level in levels:
        rows = pairs.filter(F.col("_level") == level).drop("_level")
        counter = F.lit(0).cast("long")
        if lost is not None and most_rows(lost):
            # A name is lost once; the names of this round that were lost are no more than those of the last.
            gone = lost.withColumn("_gone", F.lit(True))
            few = most_rows(lost) <= settings.broadcast_rows(pairs.sparkSession)
            rows = rows.join(F.broadcast(gone) if few else gone, NAME, "left")
            counter = F.when(F.col("_gone"), F.lit(-1)).otherwise(F.lit(0)).cast("long")
        rows = rows.withColumn("counter", counter)
        rows = rows.drop("_gone") if "_gone" in rows.columns else rows
        done = lost_rows(stage(rows, "round"), NAME, "_slot")
        lost = stage(done.filter("lost").select("directory", F.col("child").alias("name")).distinct(), "lost")
        settled.append(done.filter("not lost").select(*_SLOT).unionByName(
            lost.withColumn("_slot", F.lit(0).cast("bigint"))))
    return reduce(DataFrame.unionByName, settled, pairs.limit(0).select(*_SLOT))


def _one_by_one(requests: DataFrame, occupied: DataFrame, families: DataFrame,
                order: list[str]) -> DataFrame:
    """The sequential rule itself, for families whose names end in a dot."""
    where = ["directory", "_family"]
    rows = requests.withColumn("_family", family(F.col("name"))).join(families, where, "left_semi")
    present = occupied.select(*NAME, family(F.col("name")).alias("_family")).distinct().join(
        families, where, "left_semi")
    schema = StructType([*requests.schema.fields, StructField("final_name", StringType())])
    columns = schema.names

    def resolve(_, asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        used = set(there["name"])
        next_slot = {}
        final = []
        asked = asked.sort_values(order)
        for name in asked["name"]:
            dot = name.rfind(".")
            cut = dot if 0 < dot < len(name) - 1 else len(name)
            slot = next_slot.get(name, 0)
            while True:
                candidate = f"{name[:cut]} ({slot}){name[cut:]}" if slot else name
                slot += 1
                if candidate not in used:
                    break
            next_slot[name] = slot
            used.add(candidate)
            final.append(candidate)
        return asked.assign(final_name=final)[columns]

    return rows.groupBy(*where).cogroup(present.groupBy(*where)).applyInPandas(resolve, schema)
