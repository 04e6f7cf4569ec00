"""Connected components by large-star and small-star steps, each a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.sources.staging import measures_of, most_rows, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node.

    Edges may repeat, go either way and join a node with itself. A step points
    each node's neighbours at its smallest neighbour; steps end when every node
    points at a node that points nowhere else. Stars of a hub are split by the
    adaptive skew join, and the smallest neighbour is aggregated before the shuffle.
    """
    pairs = _new_edges(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    nodes = stage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    while most_rows(pairs):
        larger = _star(pairs.union(pairs.select("b", "a").toDF("a", "b")), "large")
        smaller = _star(larger, "small")
        before, pairs = measures_of(pairs), smaller
        if measures_of(pairs)["rows"] == before["rows"] and measures_of(pairs)["sum"] == before["sum"]:
            break
    return nodes.join(pairs.select(F.col("a").alias("node"), F.col("b").alias("_root")), "node", "left").select(
        "node", F.coalesce("_root", "node").alias("component"))


def _new_edges(pairs: DataFrame) -> DataFrame:
    """Distinct edges, larger node first, with a checksum that changes when any edge does."""
    return stage(pairs.filter("a != b").distinct(), "edges",
                 sum=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))


def _star(pairs: DataFrame, kind: str) -> DataFrame:
    """Edges from the neighbours of each node ``a`` to the smallest node around it.

    Large: neighbours greater than the node. Small: the node itself and its
    lesser neighbours; edges run from the greater node here.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("_m"))
    least = stage(least.select("a", F.least("a", "_m").alias("_m")), "least")
    joined = pairs.join(least, "a")
    if kind == "large":
        return _new_edges(joined.filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")))
    own = least.select("a", F.col("_m").alias("b"))
    return _new_edges(joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(own))
