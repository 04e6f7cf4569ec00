"""Files with equal content: sizes first, digests second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline import settings
from stowline.functions.digests import content_digest, digest_by_path
from stowline.functions.names import scan_key
from stowline.operators.bloom import blocks_for, bloom_blocks, keep_possible
from stowline.operators.matching import keep_matching
from stowline.operators.ordinal import number_within, with_ordinal
from stowline.sources.staging import measures_of, most_rows, stage
from stowline.sources.stores import deal_by_bytes

CHUNK_MEMBERS = 100_000  # members of one group joined in one task


def size_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("size").agg(F.count("*").alias("n_files"))


def shared_sizes(files: DataFrame) -> DataFrame:
    return size_counts(files.filter("size is not null")).filter("n_files >= 2")


def with_shared_size(files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Files that may share a size with another, filtered in the scan, and what makes the filter exact.

    The shorter of the two lists, shared or unique sizes, is broadcast so that
    contents are not shuffled, and None is returned with it. When neither list
    is short enough, a Bloom filter of the shared sizes takes its place: it has a
    bounded size and lets few others through; the table of shared sizes that
    then comes second is to be matched once the rows are narrow.
    """
    spark = files.sparkSession
    files = files.filter("size is not null")
    sizes = stage(size_counts(files), "sizes", shared=F.count_if(F.col("n_files") >= 2),
                  unique=F.count_if(F.col("n_files") == 1))
    limit = settings.broadcast_rows(spark)
    shared, unique = (measures_of(sizes)[m] for m in ("shared", "unique"))
    found = sizes.filter("n_files >= 2").select("size")
    if min(shared, unique) > limit:
        blocks = blocks_for(spark, shared)
        key = F.xxhash64("size")
        return keep_possible(files, key, bloom_blocks(found, key, blocks), blocks), found
    if shared <= unique:
        return files.join(F.broadcast(found), "size", "left_semi"), None
    return files.join(F.broadcast(sizes.filter("n_files = 1").select("size")), "size", "left_anti"), None


def digest_table(files: DataFrame, algorithm: str | None = None) -> DataFrame:
    """(path, rel_path, size, digest, error) of the files that share a size; staged.

    ``files`` has ``content``, or else paths that executors can open. Contents
    are read once here and appear in no shuffle. ``error`` tells why a file has
    no digest: its content is absent, its length is not the recorded size, or no
    size is recorded. Rows that share a path (a file and links to it) are one
    file, the first in scan order.
    """
    kept = ["path", "rel_path", "size"]
    unsized = files.filter("size is null").select(
        *kept, F.lit(None).cast("string").alias("digest"), F.lit("size unknown").alias("error"))
    files = files.filter("size is not null")
    if "content" not in files.columns:
        chosen, exact = with_shared_size(files.select(*kept))
        if exact is not None:
            chosen = keep_matching(chosen, exact, ["size"])
        found = digest_by_path(deal_by_bytes(chosen), algorithm).select(*kept, "digest", "error")
        return stage(_one_file_per_path(found.unionByName(unsized)), "digests")
    chosen, exact = with_shared_size(files)
    table = _checked(chosen, algorithm).select(*kept, "digest", "error")
    if exact is not None:
        # Strangers that the filter let through were digested; the size rule now applies to rows without contents.
        table = keep_matching(stage(table, "digested"), exact, ["size"])
    return stage(_one_file_per_path(table.unionByName(unsized)), "digests")


def _one_file_per_path(table: DataFrame) -> DataFrame:
    rest = [c for c in table.columns if c != "path"]
    first = F.min_by(F.struct(*rest), F.struct(scan_key(F.col("rel_path"))))
    return table.groupBy("path").agg(first.alias("_first")).select("path", "_first.*")


def _checked(files: DataFrame, algorithm: str | None) -> DataFrame:
    error = (F.when(F.col("content").isNull(), "missing")
             .when(F.octet_length("content") != F.col("size"), "size mismatch"))
    return files.withColumn("error", error).withColumn(
        "digest", F.when(error.isNull(), content_digest(F.col("content"), algorithm)))


def digest_groups(digests: DataFrame) -> DataFrame:
    """(digest, size, n_files, recoverable) of digests with two or more files."""
    return (digests.filter("digest is not null").groupBy("digest")
            .agg(F.min("size").alias("size"), F.count("*").alias("n_files"))
            .filter("n_files >= 2")
            .withColumn("recoverable", recoverable(F.col("n_files"), F.col("size"))))


def recoverable(n_files: Column, size: Column) -> Column:
    return F.greatest(n_files - 1, F.lit(0)) * size


def digest_members(digests: DataFrame) -> DataFrame:
    """Members of duplicate groups with ``member_no`` in scan order and ``n_files``."""
    found = digests.filter("digest is not null").drop("error")
    return (number_within(found, ["digest"], [scan_key(F.col("rel_path")), "path"],
                          "member_no", count_as="n_files", at_most=most_rows(digests))
            .filter("n_files >= 2"))


def groups_of(members: DataFrame) -> DataFrame:
    """One row per group, with the place of its first member."""
    return members.filter("member_no = 1").select(
        "digest", "size", "n_files",
        recoverable(F.col("n_files"), F.col("size")).alias("recoverable"),
        scan_key(F.col("rel_path")).alias("first_seen"))


def number_groups(groups: DataFrame, at_most: int | None = None) -> DataFrame:
    """``group_no``: largest files first, ties in scan order of the first member."""
    return with_ordinal(groups, [F.desc("size"), F.asc("first_seen")], "group_no", at_most)


def join_groups(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Columns of ``groups`` (digest, n_files, ...) on each member.

    Members go by (digest, chunk of member numbers) and a group is repeated once
    per chunk, so a huge group spreads over tasks.
    """
    own = ["digest", *[c for c in groups.columns if c not in members.columns]]
    last = F.floor((F.col("n_files") - 1) / CHUNK_MEMBERS).cast("bigint")
    pieces = groups.select(*own, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_chunk"))
    chunk = F.floor((F.col("member_no") - 1) / CHUNK_MEMBERS).cast("bigint")
    return members.withColumn("_chunk", chunk).join(pieces, ["digest", "_chunk"]).drop("_chunk")
