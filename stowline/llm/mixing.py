"""Mixing sources to target weights by weighted fair queueing.

Each source offers its documents in a shuffled order, a second time after the
first. A document's virtual finish time is the words its source has offered up
to and with it, divided by the source's target. Served by finish time, sources
fill their targets side by side; the mix ends when its budget of words is spent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowline.llm.common import WORDS, checked_broadcast
from stowline.operators.ordinal import with_ordinal
from stowline.sources.staging import measures_of, most_rows, stage

WEIGHTS, SHARE, ROUNDS = (3, 1, 2), 1.5, 2
SEED = "mix:"


def words_in(text: Column) -> Column:
    """Number of words, as a long; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, str],
                 group: str | None = None) -> DataFrame:
    """``df`` plus, for each ``out: column`` of longs, its sum over the rows up to and with this one.

    Rows are ordered by ``group`` (a long) and ``order`` over ranges; each task
    sums its own range, and the ranges' totals, one row for each range and each
    group that begins in it, give what lies before.
    """
    by = ([group] if group else []) + order
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()),
                           *[T.StructField(out, T.LongType()) for out in sums]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group).to_numpy() if group else np.zeros(batch.num_rows, np.int64)
            starts = np.append(True, keys[1:] != keys[:-1])
            starts[0] = keys[0] != last
            begin = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), -1))
            last = keys[-1]
            new = []
            for out, column in sums.items():
                total = np.append(0, np.cumsum(batch.column(column).to_numpy()))
                own = total[1:] - np.where(begin >= 0, total[begin], -carried[out])
                carried[out] = int(own[-1])
                new.append(pa.array(own))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), part, np.int32)), *new], schema.names)

    placed = stage(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), "running")
    keys = ["_part", *([group] if group else [])]
    earlier = Window.partitionBy(*([group] if group else [])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    tallies = placed.groupBy(*keys).agg(*[F.max(out).alias(f"_{out}") for out in sums]).withColumns(
        {f"_{out}": F.coalesce(F.sum(f"_{out}").over(earlier), F.lit(0)) for out in sums})
    joined = placed.join(checked_broadcast(stage(tallies, "tallies")), keys)
    return joined.withColumns({out: F.col(out) + F.col(f"_{out}") for out in sums}).drop(
        "_part", *[f"_{out}" for out in sums])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            rounds: int = ROUNDS) -> DataFrame:
    """(source, rank, source_size, target) of ``sources`` (source, source_size); staged.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes. Targets stop at ``rounds`` times the source's
    size; the excess goes to the others by weight until none is above.
    """
    named = stage(sources.select("source", "source_size"), "sources", total=F.sum("source_size"))
    budget = share * (measures_of(named)["total"] or 0)
    ranked = with_ordinal(named, [F.asc_nulls_last("source")], "rank", most_rows(named))
    cap = (F.col("source_size") * rounds).cast("long")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, len(weights)).cast("int") + 1)
    # Filled evenly by weight, a source meets its cap at level cap / weight.
    level = stage(ranked.withColumns({"_cap": cap, "_w": weight.cast("long")}).withColumn(
        "_level", F.col("_cap").cast("double") / F.col("_w")), "levels", weights=F.sum("_w"))
    all_weights = measures_of(level)["weights"] or 0
    met = running_sums(level, ["_level", "rank"], {"_caps": "_cap", "_ws": "_w"})
    spent = F.col("_caps") + F.col("_level") * (all_weights - F.col("_ws"))
    full = stage(met.withColumn("_full", spent <= budget), "filled",
                 caps=F.sum(F.when(F.col("_full"), F.col("_cap"))), ws=F.sum(F.when(F.col("_full"), F.col("_w"))))
    caps, ws = (measures_of(full)[m] or 0 for m in ("caps", "ws"))
    level = (budget - caps) / (all_weights - ws) if all_weights > ws else 0.0
    return stage(full.select("source", "rank", "source_size", F.when(
        F.col("_full"), F.col("_cap").cast("double")).otherwise(level * F.col("_w")).alias("target")), "targets")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, rounds: int = ROUNDS,
        seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and (doc_id, size, source_size, target, copies, taken) of every document.

    ``copies`` says how often the mix takes it (0 to ``rounds``), ``taken`` the
    words of those. The order of a source is by the hash of ``seed`` and doc_id,
    so reruns agree. Null texts have size 0; a null source is a source; a null
    doc_id hashes as the empty text. Repeated rows are documents of their own.
    Documents of a source without words are not taken. Documents alike in source,
    doc_id and size stand in the order of ``keep``. Other columns are ignored.
    """
    sized = stage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"),
                              words_in(F.col(text)).alias("size"), *keep), "sized")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, rounds)
    same = F.col("s.source").eqNullSafe(F.col("g.source"))
    shuffled = sized.alias("s").join(checked_broadcast(goal).alias("g"), same).select(
        "doc_id", "size", "rank", "source_size", "target", *keep,
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("turn"))
    offered = stage(running_sums(shuffled, ["turn", "doc_id", "size", *keep], {"offered": "size"}, "rank"), "offered")

    def finish(again: Column) -> Column:
        return F.try_divide((again * F.col("source_size") + F.col("offered")).cast("double"), F.col("target"))

    place = ["rank", "turn", "doc_id", "size", *keep]
    items = offered.withColumn("again", F.explode(F.array(*[F.lit(r).cast("long") for r in range(rounds)])))
    items = items.select(finish(F.col("again")).alias("finish"), *place, "again").filter("finish is not null")
    budget = share * (sized.agg(F.sum("size")).first()[0] or 0)
    served = running_sums(items, ["finish", *place, "again"], {"served": "size"})
    cut = served.filter(F.col("served") <= budget).agg(
        F.max(F.struct("finish", *place, "again")).alias("last")).select("last.*").first()
    if cut is None or cut["finish"] is None:
        copies = F.lit(0)
    else:
        last = F.struct(*[F.lit(cut[c]).cast(kind).alias(c) for c, kind in items.dtypes])
        copies = sum((F.when(F.struct(finish(F.lit(r)).alias("finish"), *place,
                                      F.lit(r).cast("long").alias("again")) <= last, 1).otherwise(0)
                      for r in range(rounds)), F.lit(0))
        copies = F.when(finish(F.lit(0)).isNull(), 0).otherwise(copies)
    return offered.withColumn("copies", copies.cast("int")).select(
        *keep, "doc_id", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"))
