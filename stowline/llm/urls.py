"""URL filters: the longest matching allow or block entry decides.

Entries lie in a trie whose edges are host labels from the right and then path
segments. A url walks the trie once; the deepest host node with a fitting path
wins, and on that node the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowline.sources.staging import most_rows, stage

ALLOW, BLOCK = "allow", "block"
#: Bounds of the broadcast trie; more or longer entries are joined instead.
TRIE_RULES = 100_000
TRIE_BYTES = 16_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DECIDED = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(_after(url, r"^([^/?#]*)"), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return _after(url, r"^[^/?#]*([^?#]*)")


def _after(url: Column, pattern: str) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.regexp_extract(rest, pattern, 1)).otherwise("")


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, host, path) of entries like ``("block", "example.org/es/")``."""
    rows = [(verdict, *_split(entry)) for verdict, entry in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def _split(entry: str) -> tuple[str, str]:
    host, slash, path = entry.partition("/")
    return host, slash + path


class Trie:
    """Host labels from the right, then path segments; the last segment is a prefix."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else []:
                node = node.setdefault("labels", {}).setdefault(label, {})
            place = node.setdefault("paths", {})
            *whole, last = path.split("/")
            for segment in whole:
                place = place.setdefault("segments", {}).setdefault(segment, {})
            ends = place.setdefault("ends", {})
            # One entry both allowed and blocked is blocked.
            if ends.get(last, (ALLOW,))[0] == ALLOW:
                ends[last] = (verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest entry that fits."""
        segments = path.split("/")
        found = _longest_path(self.root, segments)
        node = self.root
        for label in reversed(host.split(".")) if host else []:
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            found = _longest_path(node, segments) or found
        return found


def _longest_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
    place, found = node.get("paths"), None
    for segment in segments:
        if place is None:
            break
        ends = place.get("ends")
        if ends:
            for length in range(len(segment), -1, -1):
                if segment[:length] in ends:
                    found = ends[segment[:length]]
                    break
        place = place.get("segments", {}).get(segment)
    return found


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = (),
                otherwise: str = ALLOW) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    ``rules`` has verdict, host and path. A rule fits its host and all
    subdomains if the url's path starts with the rule's. More host labels win,
    then the longer path; an entry on both lists blocks. Urls without an entry
    get ``otherwise``. A null url, or one without ``://``, has empty host and
    path, which only rules of the empty host and path fit. Repeated rows are
    judged alike; other columns of ``pages`` are ignored.
    """
    rules = stage(rules.select("verdict", "host", "path"), "rules",
                  bytes=F.sum(F.octet_length("host") + F.octet_length("path")))
    parts = pages.select(*keep, url_host(F.col(url)).alias("_h"), url_path(F.col(url)).alias("_p"))
    size = rules.staged_measures
    if size["rows"] <= TRIE_RULES and (size["bytes"] or 0) <= TRIE_BYTES:
        decided = _by_trie(parts, rules)
    else:
        decided = _by_join(parts, rules)
    return decided.select(*keep, F.col("_h").alias("host"), F.col("_p").alias("path"), "rule",
                          F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def _by_trie(parts: DataFrame, rules: DataFrame) -> DataFrame:
    trie = parts.sparkSession.sparkContext.broadcast(
        Trie([tuple(r) for r in rules.sort("verdict", "host", "path").collect()]))

    @F.pandas_udf(_DECIDED)
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for hosts, paths in batches:
            found = [find(h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [rule for _, rule in found],
                                "verdict": [verdict for verdict, _ in found]}, dtype=object)

    return parts.withColumn("_d", decide("_h", "_p")).select(
        *parts.columns, "_d.rule", "_d.verdict")


def _by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by equality of (host suffix, path prefix), for lists too long to broadcast.

    Each distinct (host, path) asks only for path prefixes of lengths that some
    rule has; a key has one rule at most, so hot keys lie on one side only.
    """
    # max picks "block" over "allow" for an entry on both lists.
    unique = stage(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules")
    lengths = stage(unique.groupBy(F.length("path").alias("n")).count(), "lengths")
    sites = stage(parts.groupBy("_h", "_p").agg(F.count("*").alias("_n")), "sites")
    labels = F.split("_h", r"\.")
    first = F.when(F.col("_h") == "", F.lit(0)).otherwise(F.size(labels))
    asked = sites.withColumn("_k", F.explode(F.sequence(F.lit(0), first))).withColumn(
        "_suffix", F.concat_ws(".", F.slice(labels, F.size(labels) - F.col("_k") + 1, F.col("_k"))))
    asked = asked.join(F.broadcast(lengths) if most_rows(lengths) <= 10_000 else lengths,
                       F.col("n") <= F.length("_p"))
    asked = asked.withColumn("_prefix", F.substr("_p", F.lit(1), F.col("n").cast("int")))
    found = asked.join(unique, (F.col("_suffix") == F.col("host")) & (F.col("_prefix") == F.col("path")))
    best = found.groupBy("_h", "_p").agg(F.max_by(
        F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct("_k", "n")).alias("_d"))
    return parts.join(best, ["_h", "_p"], "left").select(*parts.columns, "_d.rule", "_d.verdict")
