"""Approximate nearest neighbours by p-stable hashing with multiprobe.

A table hashes a vector to the slots of several random projections of a given
width. A query visits its own bucket and perturbed ones, in the order of the
estimated chance that a near vector lies there, until that chance is spent.
The near distance, the width and the number of projections are fitted on a
bounded sample whose true neighbours are searched among all rows.

Bucket rows and visits meet in tasks that keep each query's nearest, so no list
of candidates is shuffled. Large buckets are split and visited in each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from math import erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowline.llm.vectors import QUERY_BLOCK, Best, distances, matrix, nearest, scan_exactly, usable
from stowline.sources.staging import most_rows, stage

TABLES = 4
#: Queries whose neighbours are searched exactly to fit and to audit; rows that slots are fitted on.
FITTED, SAMPLE = 64, 4096
#: Rows aimed at in a bucket, and rows of a bucket above which it is split.
BUCKET, SPLIT = 256, 20_000
#: Estimated chance, over all tables, that a true neighbour's bucket is visited.
SUCCESS = 0.985
SEED = 20_240


def near_neighbours(rows: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id",
                    embedding: str = "embedding", success: float = SUCCESS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found among ``rows``.

    Both inputs have the id and the vector; a row with the query's own id is no
    candidate. The score is the Euclidean distance in double precision, ties go
    to the smaller id. Vectors that are null, empty, zero or not finite, and
    rows without an id, take no part. A repeated query row counts once, and a
    candidate id that repeats stands once, at its nearest. Fewer candidates than
    ``k`` are all returned. Queries for which the buckets held fewer than ``k``
    are searched exactly. Other columns are ignored.
    """
    rows = stage(usable(rows, vec_id, embedding), "vectors")
    queries = stage(usable(queries, vec_id, embedding).dropDuplicates(["vec_id"]).select(
        F.col("vec_id").alias("query_id"), "vec"), "queries")
    if not most_rows(queries):
        return queries.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"),
                              F.lit(0.0).alias("score"))
    kept = stage(_classes(rows, k), "kept")
    found = stage(nearest(_search(kept, queries, _fit(kept, queries, k), k, success), k), "found")
    few = stage(queries.join(found.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti"), "few")
    if not most_rows(few):
        return found
    exact = _exactly(few, kept, k)
    return found.join(few, "query_id", "left_anti").unionByName(exact)


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids: no query needs more, its own id included."""
    order = Window.partitionBy("vec").orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n")


def _exactly(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """All queries against all rows, block after block; each block is a table when the next begins."""
    numbered = stage(queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(
        -(-most_rows(queries) * 4 // QUERY_BLOCK)))), "numbered")
    parts = []
    for (block,) in numbered.select("_b").distinct().collect():
        held = [(r["query_id"], r["vec"]) for r in numbered.filter(F.col("_b") == block).collect()]
        for start in range(0, len(held), QUERY_BLOCK):
            parts.append(stage(nearest(scan_exactly(held[start:start + QUERY_BLOCK], rows, k), k), "exact"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Hashing:
    """Projections, offsets and width of all tables, and the order of visits."""

    def __init__(self, dim: int, projections: int, width: float, near: float):
        draw = np.random.default_rng(SEED)
        self.width, self.near, self.each = width, near, projections
        self.planes = draw.standard_normal((TABLES, dim, projections))
        self.offsets = draw.uniform(0, width, (TABLES, projections))

    def slots(self, vectors: np.ndarray, t: int) -> np.ndarray:
        """Positions of the vectors on the projections of table ``t``, in slot widths."""
        return (vectors @ self.planes[t] + self.offsets[t]) / self.width

    @staticmethod
    def keys(slots: np.ndarray) -> np.ndarray:
        """One 64-bit key for each row of slot numbers."""
        key = np.zeros(len(slots), np.uint64)
        for column in slots.astype(np.int64).astype(np.uint64).T:
            key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.astype(np.int64)

    def visits(self, position: np.ndarray, success: float) -> np.ndarray:
        """Slot numbers of the buckets to visit in one table, likeliest first.

        A near vector's projection differs from the query's by a normal of
        deviation ``near``. Perturbation sets are made in falling order of their
        chance by a heap over the slots' choices; they end when their sum
        reaches what each table must add for ``success`` over all tables.
        """
        home = np.floor(position)
        steps = np.arange(-4, 5)
        edges = (home[:, None] + steps - position[:, None]) * (self.width / self.near)
        chance = _normal(edges + self.width / self.near) - _normal(edges)
        order = np.argsort(-chance, axis=1, kind="stable")
        chance = np.maximum(np.take_along_axis(chance, order, 1), 1e-12)
        cost = (np.log(chance[:, :1]) - np.log(chance)).tolist()
        base = float(np.log(chance[:, 0]).sum())
        needed = 1 - (1 - success) ** (1 / TABLES)
        most = len(steps) - 1
        start = (0,) * self.each
        agenda, out, total = [(0.0, start, 0)], [], 0.0
        while agenda and total < needed:
            spent, choice, free = heappop(agenda)
            out.append(choice)
            total += exp(base - spent)
            # Each choice has one parent: the last raised projection goes down by one.
            for p in range(free, self.each):
                if choice[p] < most:
                    heappush(agenda, (spent + cost[p][choice[p] + 1] - cost[p][choice[p]],
                                      (*choice[:p], choice[p] + 1, *choice[p + 1:]), p))
        picked = order[np.arange(self.each), np.array(out)]
        return home + steps[picked]


_normal = np.vectorize(lambda x: (1 + erf(x / sqrt(2))) / 2)


def _fit(rows: DataFrame, queries: DataFrame, k: int) -> Hashing:
    """Near distance from a few queries' true neighbours; width and projections from a sample of rows."""
    few = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(FITTED).collect()
    true = nearest(scan_exactly([(r["query_id"], r["vec"]) for r in few], rows, k), k)
    last = [r[0] for r in true.groupBy("query_id").agg(F.max("score")).select("max(score)").collect()]
    near = max(float(np.quantile(last, 0.9)) if last else 0.0, 1e-9)
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select(
        "vec").toArrow().column(0).combine_chunks())
    dim = sample.shape[1] if len(sample) else len(few[0]["vec"])
    spread = float(np.sqrt(sample.var(axis=0).sum())) if len(sample) else 1.0
    width = 1.6 * near
    # Nats that one projection tells apart: the entropy of a normal cut into slots.
    each = max(log(spread * sqrt(2 * pi * exp(1)) / width) if spread > 0 else 0.0, 0.25)
    projections = int(np.clip(round(log(max(most_rows(rows) / BUCKET, 1)) / each), 1, 24))
    return Hashing(dim, projections, width, near)


def _search(rows: DataFrame, queries: DataFrame, hashing: Hashing, k: int, success: float) -> DataFrame:
    """(query_id, vec_id, score) of each task's nearest."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                vectors = matrix(part.column(1))
                for t in range(TABLES):
                    keys = Hashing.keys(np.floor(hashing.slots(vectors, t)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, t, np.int32)), pa.array(keys), *part.columns],
                        ["table", "key", "vec_id", "vec"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                vectors = matrix(part.column(1))
                for t in range(TABLES):
                    found = [Hashing.keys(hashing.visits(p, success)) for p in hashing.slots(vectors, t)]
                    at = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, np.int32)), pa.array(np.concatenate(found)),
                         *pa.Table.from_batches([part]).take(pa.array(at)).combine_chunks().to_batches()[0].columns],
                        ["table", "key", "query_id", "vec"])

    placed = rows.select("vec_id", "vec").mapInArrow(place, "table int, key long, vec_id long, vec array<double>")
    visits = queries.mapInArrow(visit, "table int, key long, query_id long, vec array<double>")
    large = stage(placed.groupBy("table", "key").agg(F.count("*").alias("n")).filter(
        F.col("n") > SPLIT).withColumn("parts", F.ceil(F.col("n") / SPLIT).cast("int")).drop("n"), "large")
    if most_rows(large):
        placed = placed.join(large, ["table", "key"], "left").withColumn(
            "part", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        visits = visits.join(large, ["table", "key"], "left").withColumn("part", F.explode(
            F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    else:
        placed, visits = placed.withColumn("part", F.lit(0)), visits.withColumn("part", F.lit(0))
    both = placed.withColumn("query", F.lit(False)).union(visits.withColumn("query", F.lit(True)))
    met = both.toDF("table", "key", "id", "vec", "part", "query").repartition("table", "key", "part")
    return met.sortWithinPartitions("table", "key", "part", "query").select(
        "table", "key", "part", "query", "id", "vec").mapInArrow(
        lambda batches: _meet(batches, k), "query_id long, vec_id long, score double")


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket come first, then its visits; a bucket has ``SPLIT`` rows or so at most."""
    best = Best(k)
    bucket, ids, vectors = None, [], []
    for batch in batches:
        marks = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        is_query = batch.column(3).to_numpy(zero_copy_only=False)
        own, rows = batch.column(4).to_numpy(), matrix(batch.column(5))
        start = 0
        while start < len(marks):
            end = start + 1
            while end < len(marks) and marks[end] == marks[start]:
                end += 1
            if marks[start] != bucket:
                bucket, ids, vectors = marks[start], [], []
            cut = start + int((~is_query[start:end]).sum())
            if cut > start:
                ids.append(own[start:cut])
                vectors.append(rows[start:cut])
            if cut < end and ids:
                ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                for at in range(cut, end):
                    other = ids[0] != own[at]
                    near = distances(vectors[0], rows[at])
                    if other.sum() > k:
                        limit = np.partition(near[other], k - 1)[k - 1]
                        other &= near <= limit
                    best.add(int(own[at]), ids[0][other], near[other])
            start = end
    yield from best.batches()


def audit_recall(rows: DataFrame, found: DataFrame, k: int = 10, vec_id: str = "vec_id",
                 embedding: str = "embedding", queries: int = FITTED) -> float:
    """Share of the true k nearest that ``found`` has, over a sample of its queries."""
    rows = usable(rows, vec_id, embedding)
    asked = found.select("query_id").distinct().orderBy(F.xxhash64("query_id", F.lit(1)), "query_id").limit(queries)
    block = [(r[0], r[1]) for r in rows.join(
        F.broadcast(asked), F.col("vec_id") == F.col("query_id"), "left_semi").collect()]
    true = nearest(scan_exactly(block, rows, k), k).select("query_id", "vec_id")
    total = true.count()
    return true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"]).count() / total if total else 1.0
