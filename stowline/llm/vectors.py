"""Vectors as arrays of columns: usable rows, classes of equal vectors, exact search in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 512


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vec) of rows with an id whose vector is not null, empty or zero and all finite."""
    return _plain(rows, vec_id, embedding).filter(_usable())


def unusable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vec) of all other rows."""
    return _plain(rows, vec_id, embedding).filter(~F.coalesce(_usable(), F.lit(False)))


def _plain(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"),
                       F.col(embedding).cast("array<double>").alias("vec"))


def _usable() -> Column:
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0) & F.col("vec_id").isNotNull()


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's list column as rows of doubles; all lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    return np.sqrt(np.square(rows - query).sum(axis=1))


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of (query_id, vec_id, score), repeated candidates counted once, with ``rank``."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def scan_exactly(queries: list[tuple[int, list[float]]], rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows of a stated block of queries, found among all rows (vec_id, vec).

    ``queries`` has at most ``QUERY_BLOCK`` entries. Each task sends its own k nearest.
    """
    if len(queries) > QUERY_BLOCK:
        raise ValueError("too many queries for one block")
    ids = np.array([q for q, _ in queries], np.int64)
    block = np.array([v for _, v in queries], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            vec_ids, vectors = batch.column(0).to_numpy(), matrix(batch.column(1))
            for start in range(0, len(vec_ids), 8192):
                some, own = vectors[start:start + 8192], vec_ids[start:start + 8192]
                near = np.sqrt(np.maximum((some ** 2).sum(1) - 2 * block @ some.T + (block ** 2).sum(1)[:, None], 0))
                for q, row in zip(range(len(ids)), near, strict=True):
                    top = np.argpartition(row, min(k + 8, len(row) - 1))[:k + 9]
                    top = top[own[top] != ids[q]]
                    best.add(ids[q], own[top], distances(some[top], block[q]))
        yield from best.batches()

    return rows.select("vec_id", "vec").mapInArrow(run, "query_id long, vec_id long, score double")


class Best:
    """The k nearest candidates of each query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.held:
            ids = np.concatenate([self.held[query][0], ids])
            scores = np.concatenate([self.held[query][1], scores])
        ids, first = np.unique(ids, return_index=True)
        order = np.lexsort((ids, scores[first]))[:self.k]
        self.held[query] = ids[order], scores[first][order]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for query, (ids, scores) in self.held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), query, np.int64)), pa.array(ids), pa.array(scores)],
                ["query_id", "vec_id", "score"])
