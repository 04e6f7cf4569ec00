"""Quality by hierarchical empirical Bayes: a document's own evidence and its site's record.

A logistic classifier of word shapes gives each document's evidence. Its
expected labels, summed by host and by path within the host, give each site a
posterior share of good documents: hosts shrink towards the whole corpus and
paths towards their host, the more the fewer documents they have. How strongly
is learnt from how much sites differ beyond chance. A document's posterior is
its evidence on top of the share of its path's and host's other documents, so
that its own evidence counts once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import Memory, bound_batches, checked_broadcast, slices, strings
from stowline.llm.labelled import Adam, Sparse, held_out, sample_ids, sample_texts, sigmoid
from stowline.sources.staging import measures_of, stage

#: Bound of the training sample: labelled documents of each class.
EACH = 6000
#: Hashed shapes, and one feature more: the share of words that repeat the word before.
BUCKETS = 4096
WIDTH = BUCKETS + 1
STEPS, RATE, SHRINK = 300, 0.3, 2e-5
#: Limits of the documents that a prior is worth.
LEAST, MOST = 2.0, 1e6
_REMEMBERED = 40_000
_REPEAT = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """``Word,`` is ``Aa,``: runs of letters and digits by kind, other characters once each."""
    marked = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return _REPEAT.sub(r"\1", marked)


class Shapes:
    """Square roots of the shares of a text's words by hashed shape; remembers words."""

    def __init__(self):
        self._known = Memory(lambda word: xxhash.xxh32_intdigest(shape(word)) % BUCKETS, _REMEMBERED)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if text else []
        counts = Counter(map(self._known.__getitem__, words))
        counts[BUCKETS] = sum(map(eq, words, islice(words, 1, None)))
        places = np.array(sorted(counts), np.int64)
        return places, np.sqrt([counts[p] / max(len(words), 1) for p in places.tolist()])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality") -> tuple[np.ndarray, float]:
    """(weights and bias, share of good documents) from labelled rows that are not held out.

    At most ``EACH`` documents of each class train it, the first by the hash of
    their doc_id, weighted back to the labels' share. Contradicting labels count
    as good. Without labels of both classes all documents have the same evidence.
    """
    bound_batches(docs.sparkSession)
    known = stage(labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).alias("y")).filter(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("y").alias("y")), "labels", good=F.count_if(F.col("y") == 1))
    total, good = measures_of(known)["rows"], measures_of(known)["good"] or 0
    share = (good + 1) / (total + 2)
    wanted = stage(sample_ids(known.filter("y = 1"), EACH, 1).withColumn("y", F.lit(1)).unionByName(
        sample_ids(known.filter("y = 0"), EACH, 1).withColumn("y", F.lit(0))), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in slices(batches):
            found = [shapes.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f for f, _ in found], pa.list_(pa.int64())),
                 pa.array([v for _, v in found], pa.list_(pa.float64()))], ["y", "f", "v"])

    table = sample_texts(docs, wanted, doc_id, text).select("y", "t").mapInArrow(
        run, "y int, f array<long>, v array<double>").toArrow().combine_chunks()
    # The same rows in the same order, whichever task sent them.
    table = table.take(pa.array(sorted(range(table.num_rows), key=list(zip(
        *(table.column(c).to_pylist() for c in "yfv"), strict=True)).__getitem__), pa.int64()))
    y = table.column("y").to_numpy().astype(float) if table.num_rows else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return np.append(np.zeros(WIDTH), np.log(share / (1 - share))), share
    rows = Sparse([np.array(f) for f in table.column("f").to_pylist()],
                  [np.array(v) for v in table.column("v").to_pylist()], WIDTH)
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum())
    weights = np.append(np.zeros(WIDTH), np.log(share / (1 - share)))
    adam = Adam(len(weights), RATE, SHRINK)
    for _ in range(STEPS):
        errors = weight * (sigmoid(rows.dot(weights[:-1]) + weights[-1]) - y)
        weights = adam.step(weights, np.append(rows.back(errors), errors.sum()))
    return weights, share


def evidence_column(spark, weights: np.ndarray, text: Column) -> Column:
    """Log odds of each whole text under the training share; null and blank texts have the bias alone."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shapes, w = Shapes(), shared.value
        for texts in batches:
            found = map(shapes.of, strings(texts))
            yield pa.array([w[-1] + float((w[f] * v).sum()) for f, v in found], pa.float64())

    return evidence(text)


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, n, s, hn, hs, host_share, path_share) and the priors from (host, path, log_odds); staged.

    ``n`` and ``s`` are the path's documents and the good ones expected among them,
    ``hn`` and ``hs`` the host's; the shares are their posteriors. With them come the whole corpus's ``share``, and
    the documents that it is worth to a host (``host_worth``) and a host to a path (``path_worth``).
    """
    good = _good(F.col("log_odds"))
    paths = stage(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("s")), "paths",
                  n=F.sum("n"), s=F.sum("s"))
    share = (measures_of(paths)["s"] or 0.0) / max(measures_of(paths)["n"] or 0, 1)
    share = min(max(share, 1e-6), 1 - 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    worth = _worth(hosts, F.lit(share), "hn", "hs")
    hosts = stage(hosts.withColumnRenamed("host", "_host"), "hosts")
    both = paths.join(checked_broadcast(hosts), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    host_share = _shrunk(F.col("hs"), F.col("hn"), F.lit(share), F.lit(worth))
    path_worth = _worth(both.withColumn("host_share", host_share), F.col("host_share"), "n", "s")
    both = both.withColumn("host_share", host_share)
    path_share = _shrunk(F.col("s"), F.col("n"), F.col("host_share"), F.lit(path_worth))
    return stage(both.select(
        "host", "path", "n", "s", "hn", "hs", "host_share", path_share.alias("path_share"), F.lit(share).alias("share"),
        F.lit(worth).alias("host_worth"), F.lit(path_worth).alias("path_worth")), "sites")


def _good(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _shrunk(good: Column, n: Column, prior: Column, worth: Column) -> Column:
    return (good + worth * prior) / (n + worth)


def other_shares(log_odds: Column) -> tuple[Column, Column]:
    """Posterior shares of a document's host and path from all their other documents, beside its site's columns."""
    own = _good(log_odds)
    host = _shrunk(F.col("hs") - own, F.col("hn") - 1, F.col("share"), F.col("host_worth"))
    return host, _shrunk(F.col("s") - own, F.col("n") - 1, host, F.col("path_worth"))


def _worth(groups: DataFrame, prior: Column, n: str, s: str) -> float:
    """Documents that the prior is worth, by moments: squared deviations beyond chance are real differences."""
    rate = F.col(s) / F.col(n)
    chance = prior * (1 - prior)
    row = groups.agg(F.sum(F.col(n) * (rate - prior) ** 2).alias("seen"), F.sum(chance).alias("chance"),
                     F.sum(F.col(n) * chance).alias("all"), F.sum(n).alias("n")).first()
    if not row["n"]:
        return MOST
    beyond = (row["seen"] - row["chance"]) / row["n"]  # variance of the groups' true shares
    return float(np.clip(row["all"] / row["n"] / beyond - 1, LEAST, MOST)) if beyond > 0 else MOST


def posterior(log_odds: Column, share: float, path_share: Column) -> Column:
    """Probability of a good document: its evidence apart from the training share, on its path's share."""
    prior = F.least(F.greatest(path_share, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(log_odds - float(np.log(share / (1 - share))) + F.log(prior / (1 - prior)))))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", doc_id: str = "doc_id",
          text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, host, path, held_out, log_odds, host_share, path_share, score and predicted of every document.

    ``predicted`` is 1 where the score is at least 0.5; the shares are those of the
    host's and the path's other documents. Null hosts and paths are
    sites; null and blank texts have the bias as evidence; repeated rows are
    judged alike and count each in their site. Other columns are ignored.
    """
    return _scored(docs, labels, host, path, doc_id, text, label, ()).select(
        "doc_id", "host", "path", held_out(F.col("doc_id")).alias("held_out"), "log_odds", "host_share", "path_share",
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", doc_id: str = "doc_id",
              text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` predicts to be good, with all their columns, whatever their names."""
    rows = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")]
    return _scored(docs, labels, host, path, doc_id, text, label, rows).filter("score >= 0.5").select("_row.*")


def _scored(docs: DataFrame, labels: DataFrame, host: str, path: str, doc_id: str, text: str, label: str,
            carried: Sequence[Column]) -> DataFrame:
    """Evidence, site shares and score of every document, and ``carried`` columns.

    Evidence costs far more than writing a row, so carried columns are written
    beside it, and the sites read only the three columns they need.
    """
    weights, share = train(docs, labels, doc_id, text, label)
    rows = stage(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"),
        evidence_column(docs.sparkSession, weights, F.col(text)).alias("log_odds"), *carried), "evidence")
    sites = site_posteriors(rows)
    known = sites.withColumnsRenamed({"host": "_h", "path": "_p"})
    known.staged_measures = measures_of(sites)
    same = F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))
    host_share, path_share = other_shares(F.col("log_odds"))
    return rows.join(checked_broadcast(known), same).withColumns(
        {"host_share": host_share, "path_share": path_share}).withColumn(
        "score", posterior(F.col("log_odds"), share, F.col("path_share")))
