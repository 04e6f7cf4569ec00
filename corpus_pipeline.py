"""A corpus from raw documents to token digests, stage by stage.

Each stage takes the documents its predecessor kept and returns the documents
it keeps, with all their columns; the last returns one row of tokens for each.
Null, empty and very long texts, ties, repeated rows and empty tables have the
results that the operators' docstrings state.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from stowline.llm import mixing, pieces, quality, simhash, toxicity  # noqa: E402
from stowline.llm.common import checked_broadcast, table  # noqa: E402
from stowline.llm.queries import PIECES  # noqa: E402
from stowline.sources.staging import stage  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(spark, model, F.col("text")) < 0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather good than not, given their words and their site."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    return simhash.keep_firsts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; most sources are repeated, some are cut."""
    # Ids can repeat or be null, so each row has a number of its own; among rows of one id, their content decides.
    # A row travels as one column, so that the names of its own columns don't matter.
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stage(docs.select(doc.alias("_doc"), F.xxhash64(doc).alias("_sign"),
                             F.monotonically_increasing_id().alias("_row")), "rows")
    mixed = mixing.mix(rows, "_doc.doc_id", "_doc.text", "_doc.source", keep=("_sign", "_row")).filter("copies > 0")
    taken = stage(mixed.select("_row", F.col("copies").alias("_copies")), "copies")
    return rows.join(checked_broadcast(taken), "_row").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    done = pieces.encode_decode(docs, public_tokenizers.path(PIECES), keep=("doc_id",))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       pieces.ids_sha256(F.col("ids")).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near duplicates", drop_copies),
          ("mixing", mix_sources), ("pieces", encode)]

#: The classifiers and the tokeniser have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before kept, written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
