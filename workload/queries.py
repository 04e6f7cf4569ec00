"""One query per operator or user-level operation."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.functions.digests import content_digest
from stowline.functions.names import base_name, extension, parent_dir, scan_key
from stowline.functions.sizes import human_size
from stowline.operators import duplicates as dup
from stowline.operators.classify import with_category
from stowline.operators.moves import apply_moves
from stowline.operators.naming import unique_names
from stowline.operators.ordinal import with_ordinal
from stowline.operators.scope import in_scope, without_hidden, without_ignored
from stowline.plans import organize, quarantine, reports, undo
from stowline.sources import oplog
from stowline.sources.inventory import file_record, read_inventory
from stowline.sources.staging import most_rows, stage, staging_root
from workload.fixtures import Lake

ROOT = "/lake"
BATCH = "feedc0de00000001"


def inventory_load(spark, d):
    return read_inventory(spark, f"{d}/documents.parquet", {
        "path": "concat('/docs/', source, '/', doc_id)", "rel_path": "concat(source, '/', doc_id)",
        "size": F.col("n_chars")})


def file_metadata(spark, d):
    files = Lake(spark, d).inventory().withColumn("modified", F.timestamp_seconds("modified_s"))
    return file_record(files).select("path", "name", "extension", "size",
                                     F.unix_micros("modified").alias("modified_us"))


# Scope

def scope_ignored(spark, d):
    return without_ignored(Lake(spark, d).inventory()).select("rel_path")


def scope_custom_ignore(spark, d):
    return without_ignored(Lake(spark, d).inventory(), ["src3", "fr"]).select("rel_path")


def scope_hidden(spark, d):
    return without_hidden(Lake(spark, d).inventory()).select("rel_path")


def scope_include_hidden(spark, d):
    return in_scope(Lake(spark, d).inventory(), include_hidden=True).select("rel_path")


def scope_non_recursive(spark, d):
    return in_scope(Lake(spark, d).inventory(), recursive=False).select("rel_path")


def scope_default(spark, d):
    return in_scope(Lake(spark, d).inventory()).select("rel_path")


def scan_order(spark, d):
    files = in_scope(Lake(spark, d).inventory()).select("rel_path")
    return with_ordinal(files, [scan_key(F.col("rel_path"))], "ordinal")


# Classification and scalar functions

def classify(spark, d):
    return with_category(file_record(Lake(spark, d).inventory())).select("rel_path", "extension", "category")


def classify_pages(spark, d):
    pages = Lake(spark, d).pages()
    return with_category(pages.withColumn("extension", extension(F.col("name")))).select(
        "page_id", "name", "extension", "category")


def human_size_query(spark, d):
    lake = Lake(spark, d)
    scaled = lake.inventory().select("doc_id", F.explode(F.array(*[
        F.col("size") * F.lit(m).cast("bigint") for m in (-1, 1, 1000, 1000 ** 2, 1000 ** 3)])).alias("bytes"))
    return scaled.distinct().select("doc_id", "bytes", human_size(F.col("bytes")).alias("text"))


def _digest_query(algorithm):
    def query(spark, d):
        files = Lake(spark, d).inventory()
        return files.select("doc_id", content_digest(F.col("content"), algorithm).alias("digest"))
    return query


# Duplicates

def _digests(lake: Lake) -> DataFrame:
    return dup.digest_table(in_scope(lake.inventory()))


def size_buckets(spark, d):
    return dup.shared_sizes(in_scope(Lake(spark, d).inventory()))


def dup_candidates(spark, d):
    files = in_scope(Lake(spark, d).inventory())
    return dup.digest_table(files).select("rel_path", "size", "digest")


def dup_groups(spark, d):
    return dup.digest_groups(_digests(Lake(spark, d)))


def dup_recoverable(spark, d):
    files = Lake(spark, d).inventory()
    return dup.digest_groups(dup.digest_table(files)).agg(
        F.count("*").alias("groups"), F.sum("n_files").alias("members"),
        F.sum("recoverable").alias("recoverable"))


def dup_members(spark, d):
    return dup.digest_members(_digests(Lake(spark, d))).select("digest", "member_no", "rel_path", "size")


def dup_rejects(spark, d):
    # Recorded sizes count characters, and toxic files are gone: both are found when digesting.
    lake = Lake(spark, d)
    gone = lake.table("labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("gone")).distinct()
    files = lake.inventory().withColumn("size", F.when(F.col("doc_id") % 97 != 0, F.col("n_chars"))).join(gone, "doc_id", "left").withColumn(
        "content", F.when(F.col("gone").isNull(), F.col("content")))
    return dup.digest_table(files).filter("error is not null").select("rel_path", "size", "error")


def dup_group_numbers(spark, d):
    groups = dup.number_groups(dup.groups_of(dup.digest_members(_digests(Lake(spark, d)))))
    return groups.select("group_no", "digest", "size", "n_files", "recoverable")


def dup_report(spark, d):
    members = stage(dup.digest_members(_digests(Lake(spark, d))), "members")
    groups = dup.number_groups(dup.groups_of(members), at_most=most_rows(members))
    return reports.duplicates_report(members, groups, ROOT)


# Organising

def _plan(lake: Lake) -> DataFrame:
    return organize.plan_moves(in_scope(lake.inventory()), ROOT)


def plan_moves(spark, d):
    return _plan(Lake(spark, d)).drop("scan_key")


def plan_already_organized(spark, d):
    return organize.plan_moves(Lake(spark, d).lake_now(), ROOT).drop("scan_key")


def plan_include_subfolders(spark, d):
    return organize.plan_moves(Lake(spark, d).lake_now(), ROOT, include_subfolders=True).drop("scan_key")


def plan_protected(spark, d):
    return organize.plan_moves(in_scope(Lake(spark, d).inventory()), ROOT,
                               protected_paths=["/lake/SRC3/", "rc7/en"]).drop("scan_key")


def plan_preview(spark, d):
    return reports.plan_preview(_plan(Lake(spark, d)))


def scan_listing(spark, d):
    return reports.scan_listing(in_scope(Lake(spark, d).inventory()), ROOT)


def resolve_names(spark, d):
    lake = Lake(spark, d)
    target = F.col("destination_path")
    requests = _plan(lake).select("source_path", "scan_key", parent_dir(target).alias("directory"),
                                  base_name(target).alias("name"))
    occupied = lake.occupied().withColumn("directory", F.concat(F.lit(ROOT + "/"), "directory"))
    return unique_names(stage(requests, "requests"), occupied, organize.ORDER).drop("scan_key")


def resolve_names_cascade(spark, d):
    notes = stage(Lake(spark, d).notes(), "notes")
    requests = notes.filter("not present").select("doc_id", "directory", "name")
    return unique_names(requests, notes.filter("present").select("directory", "name"), ["doc_id"],
                        most_requests=most_rows(notes))


def _outcome(lake: Lake) -> DataFrame:
    return organize.execute_plan(_plan(lake), lake.lake_now())


def apply_plan_status(spark, d):
    return _outcome(Lake(spark, d)).drop("scan_key")


def apply_plan_inventory(spark, d):
    lake = Lake(spark, d)
    return apply_moves(lake.lake_now(), _outcome(lake), ROOT).select(
        "path", "rel_path", "name", "extension", "size")


def apply_plan_twice(spark, d):
    # Scope and plan the new state: what was moved is not planned again.
    lake = Lake(spark, d)
    after = stage(apply_moves(lake.lake_now(), _outcome(lake), ROOT), "after")
    return organize.plan_moves(in_scope(after), ROOT).drop("scan_key")


def _appended(spark, d) -> str:
    lake = Lake(spark, d)
    log = f"{staging_root(spark)}/log-{uuid4().hex}"
    lake.operations().write.parquet(log)
    done = organize.organize_operations(_outcome(lake))
    oplog.append(spark, log, done, ["scan_key", "source_path"], BATCH,
                 F.lit("2024-02-01 12:00:00").cast("timestamp_ntz"))
    return log


def ops_append(spark, d):
    return oplog.read_log(spark, _appended(spark, d))


def ops_newest_batch(spark, d):
    # Only the files of the newest successful append are read.
    newest = oplog.newest_success(spark, _appended(spark, d))
    return oplog.batch_operations(newest, oplog.latest_batch_id(newest))


# Log

def ops_normalise(spark, d):
    mixed = Lake(spark, d).operations().withColumns({
        "operation_type": F.lower("operation_type"), "status": F.initcap("status"),
        "batch_id": F.when(F.col("status") == "SUCCESS", F.col("batch_id"))})
    return oplog.normalise(mixed, BATCH).select("id", "batch_id", "operation_type", "status", "error_message")


def history_recent(spark, d):
    return oplog.recent(Lake(spark, d).operations())


def history_lines(spark, d):
    return reports.history_lines(oplog.recent(Lake(spark, d).operations()))


def history_report(spark, d):
    return reports.history_report(Lake(spark, d).operations())


def latest_batch(spark, d):
    return oplog.latest_batch(Lake(spark, d).operations())


def latest_batch_ops(spark, d):
    log = Lake(spark, d).operations()
    return oplog.batch_operations(log, oplog.latest_batch_id(log))


# Quarantine

def _review(lake: Lake):
    members = stage(dup.digest_members(_digests(lake)), "members")
    groups = dup.groups_of(members)
    decided = quarantine.decide(groups, lake.decisions(groups))
    return decided, quarantine.plan_review(members, decided, ROOT)


def review_decisions(spark, d):
    lake = Lake(spark, d)
    groups = stage(dup.digest_groups(_digests(lake)), "groups")
    return quarantine.read_decisions(lake.decisions(groups), groups)


def review_plan(spark, d):
    lake = Lake(spark, d)
    _, plan = _review(lake)
    return quarantine.execute_review(plan, lake.lake_now()).select(
        "digest", "member_no", "source_path", "destination_path", "final_path")


def review_append(spark, d):
    lake = Lake(spark, d)
    log = f"{staging_root(spark)}/log-{uuid4().hex}"
    lake.operations().write.parquet(log)
    _, plan = _review(lake)
    done = quarantine.review_operations(quarantine.execute_review(plan, lake.lake_now()))
    oplog.append(spark, log, done, quarantine.ORDER, BATCH, F.lit("2024-02-01 12:00:00").cast("timestamp_ntz"))
    return oplog.read_log(spark, log)


def review_inventory(spark, d):
    lake = Lake(spark, d)
    _, plan = _review(lake)
    done = quarantine.execute_review(plan, lake.lake_now())
    return apply_moves(lake.lake_now(), done, ROOT).select("path", "rel_path", "name", "extension", "size")


def review_summary(spark, d):
    lake = Lake(spark, d)
    decided, plan = _review(lake)
    return quarantine.review_summary(decided, quarantine.execute_review(plan, lake.lake_now()))


def review_dry_run(spark, d):
    return quarantine.dry_run_summary(dup.digest_groups(_digests(Lake(spark, d))))


# Undo

def _reverse(lake: Lake) -> DataFrame:
    log = lake.operations()
    return undo.reverse_operations(log, oplog.latest_batch_id(log))


def undo_plan(spark, d):
    return _reverse(Lake(spark, d))


def undo_preview(spark, d):
    return reports.undo_preview(_reverse(Lake(spark, d)))


def _undone(lake: Lake) -> DataFrame:
    return undo.execute_undo(_reverse(lake), lake.undo_state())


def undo_apply(spark, d):
    return undo.undo_operations(_undone(Lake(spark, d)))


def undo_inventory(spark, d):
    lake = Lake(spark, d)
    return apply_moves(lake.undo_state(), undo.restored_files(_undone(lake)))


def _chained(lake: Lake):
    log, state = lake.chain_log(), stage(lake.chain_state(), "state")
    return state, undo.execute_undo(undo.reverse_operations(log, oplog.latest_batch_id(log)), state)


def undo_chains(spark, d):
    return undo.undo_operations(_chained(Lake(spark, d))[1])


def undo_chains_inventory(spark, d):
    state, outcome = _chained(Lake(spark, d))
    return apply_moves(state, undo.restored_files(outcome)).select("path", "name")


def undo_append(spark, d):
    lake = Lake(spark, d)
    log = f"{staging_root(spark)}/log-{uuid4().hex}"
    lake.operations().write.parquet(log)
    oplog.append(spark, log, undo.undo_operations(_undone(lake)), undo.ORDER, BATCH,
                 F.lit("2024-02-01 12:00:00").cast("timestamp_ntz"))
    return oplog.read_log(spark, log)


def undo_summary(spark, d):
    return undo.undo_summary(_undone(Lake(spark, d)))


def summary_counts(spark, d):
    lake = Lake(spark, d)
    outcome = _outcome(lake)
    return reports.summary_counts(
        files_scanned=in_scope(lake.inventory()),
        groups_found=dup.digest_groups(_digests(lake)),
        moves_planned=outcome, files_moved=outcome.filter("status = 'SUCCESS'"))


QUERIES = {f.__name__: f for f in [
    inventory_load, file_metadata, scope_ignored, scope_custom_ignore, scope_hidden,
    scope_include_hidden, scope_non_recursive, scope_default, scan_order, classify,
    classify_pages, size_buckets, dup_candidates, dup_groups, dup_recoverable, dup_members,
    dup_rejects, dup_group_numbers, dup_report, plan_moves, plan_already_organized,
    plan_include_subfolders, plan_protected, plan_preview, scan_listing, resolve_names,
    resolve_names_cascade, apply_plan_status, apply_plan_inventory, apply_plan_twice, ops_append, ops_newest_batch, ops_normalise,
    history_recent, history_lines, history_report, latest_batch, latest_batch_ops, review_decisions, review_plan,
    review_append, review_inventory, review_summary, review_dry_run, undo_plan, undo_preview, undo_apply, undo_inventory, undo_chains, undo_chains_inventory, undo_append,
    undo_summary, summary_counts]}
QUERIES["human_size"] = human_size_query
for _algorithm in ("sha256", "sha1", "md5"):
    QUERIES[f"digest_{_algorithm}"] = _digest_query(_algorithm)
