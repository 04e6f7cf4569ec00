"""Toxicity by positive-unlabelled learning with a non-negative risk estimator.

A linear model of the words and word beginnings a text has is trained from texts confirmed toxic and
from unlabelled ones, which hold toxic texts at the class prior's rate. The risk
of calling toxic texts clean is taken from the confirmed ones; the risk of
calling clean texts toxic is the unlabelled texts' less the share that toxic
ones have in it, and where that estimate falls below zero its gradient is turned
round, so that the model does not fit single examples.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import exp, fsum

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import Memory, bound_batches, slices, strings
from stowline.llm.labelled import Adam, Sparse, held_out, sample_ids, sample_texts, sigmoid
from stowline.sources.staging import stage

#: Bounds of the training sample and of the features that can have a weight.
POSITIVES, UNLABELLED, FEATURES = 4000, 8000, 50_000
BITS = 22
STEPS, RATE, SHRINK = 300, 0.15, 0.02
#: A feature must be in some toxic texts, and toxic texts must surely be this share of those that have it.
MIN_TEXTS, MIN_TOXIC = 3, 0.4
#: Lengths of the word beginnings that are features beside the word.
STEMS = (3, 4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 40_000


@lru_cache(maxsize=30_000)
def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, so that inflected forms share a feature."""
    forms = [word + "$", *[word[:n] for n in STEMS if len(word) >= n]]
    return tuple(xxhash.xxh64_intdigest(f) & ((1 << BITS) - 1) for f in forms)


def features(text: str | None) -> list[int]:
    """Features of a whole text's distinct words, in any case, one entry for each word."""
    return sorted(chain.from_iterable(map(word_features, set(_WORD.findall((text or "").lower())))))


class Model:
    """Weights by feature and a bias; each distinct word of a text adds its features' weights."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self._known = Memory(self._weight, _REMEMBERED)

    def _weight(self, word: str) -> float:
        return fsum([self.weights.get(f, 0.0) for f in word_features.__wrapped__(word)])

    def score(self, text: str | None) -> float:
        words = set(_WORD.findall(text.lower())) if text else set()
        z = self.bias + fsum(map(self._known.__getitem__, words))
        return 1 / (1 + exp(-max(-60.0, min(60.0, z))))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", prior: float | None = None) -> Model:
    """A model from labelled rows that are not held out, and a sample of other texts.

    At most ``POSITIVES`` toxic and ``UNLABELLED`` documents of any kind train it,
    the first by the hash of their doc_id; their features are found and counted
    by Spark and the model is fitted on the driver. ``prior`` is the share of toxic documents,
    by default that among labelled rows. Labels that contradict each other count
    as toxic. Without a toxic label every score is below 0.5.
    """
    bound_batches(docs.sparkSession)
    known = stage(labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).alias("y")).filter(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("y").alias("y")), "labels", toxic=F.count_if(F.col("y") == 1))
    total, toxic = known.staged_measures["rows"], known.staged_measures["toxic"] or 0
    if not toxic:
        return Model({}, -4.0)
    prior = prior if prior is not None else toxic / total
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    wanted = sample_ids(known.filter("y = 1"), POSITIVES, 1).withColumn("p", F.lit(True)).unionByName(
        sample_ids(ids.filter(~held_out(F.col("doc_id"))), UNLABELLED, 2).withColumn("p", F.lit(False)))
    wanted = stage(wanted, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["p", "f"])

    rows = stage(sample_texts(docs, wanted, doc_id, text).select("p", "t").mapInArrow(
        run, "p boolean, f array<int>"), "features", positives=F.count_if("p"))
    positives = rows.staged_measures["positives"] or 0
    if not positives:
        return Model({}, -4.0)
    others = max(rows.staged_measures["rows"] - positives, 1)
    # Features of toxic texts more than of others, the most frequent first; the rest weigh nothing.
    counts = rows.select("p", F.explode(F.array_distinct("f")).alias("w")).groupBy("w").agg(
        F.count_if("p").alias("n"), F.count_if(~F.col("p")).alias("u")).filter(
        (F.col("n") >= MIN_TEXTS) & (prior / positives * (F.col("n") - F.sqrt("n"))
                                     >= MIN_TOXIC / others * (F.col("u") + F.sqrt("u")))).orderBy(F.desc("n"), "w").limit(FEATURES)
    vocabulary = np.sort(np.array([r["w"] for r in counts.select("w").collect()], np.int64))
    slim = rows.mapInArrow(lambda batches: _numbered(batches, vocabulary), "p boolean, f array<int>")
    table = slim.toArrow().combine_chunks()
    # The same rows in the same order, whichever task sent them.
    table = table.take(pa.array(sorted(range(table.num_rows), key=list(zip(
        table.column("p").to_pylist(), table.column("f").to_pylist(), strict=True)).__getitem__), pa.int64()))
    is_p = table.column("p").to_numpy()
    lists = [np.array(f, np.int64) for f in table.column("f").to_pylist()]
    weights = _fit(Sparse([x for x, p in zip(lists, is_p, strict=True) if p], None, len(vocabulary)),
                   Sparse([x for x, p in zip(lists, is_p, strict=True) if not p], None, len(vocabulary)), prior)
    return Model({int(f): float(w) for f, w in zip(vocabulary, weights, strict=False) if w}, float(weights[-1]))


def _numbered(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Features as places in the vocabulary, others dropped."""
    for batch in batches:
        out = []
        for row in batch.column(1).to_pylist():
            at = np.searchsorted(vocabulary, row)
            hit = (at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == row) if len(
                vocabulary) else np.zeros(len(row), bool)
            out.append(at[hit].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["p", "f"])


def _fit(positive: Sparse, unlabelled: Sparse, prior: float) -> np.ndarray:
    """Weights and bias of the least non-negative risk, by the logistic loss.

    The risk is prior E_p[l(z)] + max(0, E_u[l(-z)] - prior E_p[l(-z)]).
    """
    weights = np.zeros(positive.width + 1)
    weights[-1] = np.log(prior / (1 - prior)) if prior < 1 else 4.0
    # Chance differences between the samples shrink with their size.
    adam = Adam(len(weights), RATE, SHRINK * prior / positive.n ** 0.5)
    for _ in range(STEPS):
        weights = adam.step(weights, risk(weights, positive, unlabelled, prior)[2])
    return weights


def risk(weights: np.ndarray, positive: Sparse, unlabelled: Sparse, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk of missing toxic texts, the estimated one of blaming clean texts, and the gradient to follow.

    Where the second is negative the gradient only leads it back above zero.
    """
    zp, zu = (s.dot(weights[:-1]) + weights[-1] for s in (positive, unlabelled))
    clean_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() if unlabelled.n else 0.0
    toxic_pull = -prior * sigmoid(-zp) / positive.n
    own, other = -prior * sigmoid(zp) / positive.n, sigmoid(zu) / max(unlabelled.n, 1)
    if clean_risk < 0:
        toxic_pull, own, other = np.zeros_like(own), -own, -other
    errors = toxic_pull + own
    gradient = np.append(positive.back(errors) + unlabelled.back(other), errors.sum() + other.sum())
    return float(prior * np.logaddexp(0, -zp).mean()), float(clean_risk), gradient


def score_column(spark, model: Model, text: Column) -> Column:
    """Score of each whole text, 0 to 1; null and empty texts have the bias alone."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for texts in batches:
            yield pa.array(map(own.score, strings(texts)), pa.float64())

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    label: str = "toxic", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``held_out``, ``score`` and ``predicted`` (score >= 0.5) of every document.

    Only the text decides a score; repeated rows score alike. Other columns are
    ignored unless kept.
    """
    model = train(docs, labels, doc_id, text, label)
    scored = docs.select(*keep, held_out(F.col(doc_id)).alias("held_out"),
                         score_column(docs.sparkSession, model, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
