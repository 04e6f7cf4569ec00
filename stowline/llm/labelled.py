"""Shared by the classifiers: held-out rows, bounded samples and sparse numpy arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the decimal doc_id modulo ``folds`` is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample_ids(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """At most ``most`` distinct doc_ids of ``rows``, those with the smallest hashes."""
    ids = rows.select("doc_id").filter("doc_id is not null").distinct()
    return ids.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(most)


def sample_texts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(text as ``t``, the other columns of ``wanted``): one text for each row of ``wanted`` (doc_id, ...).

    Of the texts of a repeated id the first in order stands for it, so that the
    sample is bounded by the ids, however often one repeats.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    one = texts.join(F.broadcast(wanted), "doc_id").groupBy(*wanted.columns).agg(F.min("t").alias("t"))
    return one.drop("doc_id")


class Sparse:
    """Rows of (feature, value) lists as flat arrays, with products by row and by feature."""

    def __init__(self, features: list[np.ndarray], values: list[np.ndarray] | None, width: int):
        self.n, self.width = len(features), width
        self.row = np.repeat(np.arange(self.n), [len(f) for f in features])
        self.column = np.concatenate([np.zeros(0, np.int64), *features]).astype(np.int64)
        self.value = np.concatenate([np.zeros(0), *values]) if values is not None else None

    def dot(self, weights: np.ndarray) -> np.ndarray:
        each = weights[self.column]
        return np.bincount(self.row, each if self.value is None else each * self.value, self.n)

    def back(self, errors: np.ndarray) -> np.ndarray:
        each = errors[self.row]
        return np.bincount(self.column, each if self.value is None else each * self.value, self.width)


class Adam:
    """Steps on one vector, with shrinkage towards zero (the last entry, the bias, is spared)."""

    def __init__(self, size: int, rate: float, shrink: float):
        self.rate, self.shrink, self.t = rate, shrink, 0
        self.mean, self.square = np.zeros(size), np.zeros(size)

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.01 * (gradient ** 2 - self.square)
        scale = self.rate / (np.sqrt(self.square / (1 - 0.99 ** self.t)) + 1e-6)
        weights = weights - scale * self.mean / (1 - 0.9 ** self.t)
        cut = np.minimum(self.shrink * scale, np.abs(weights))
        cut[-1] = 0
        return weights - np.sign(weights) * cut


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
