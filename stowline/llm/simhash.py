"""Near-duplicate texts by SimHash fingerprints at a small bit distance.

The bits of a fingerprint fall into segments; the number of ones of each
segment is a point of a small grid. The Manhattan distance of two points is a
lower bound of the bit distance, so fingerprints within ``max_bits`` lie within
``max_bits`` steps on the grid, and each of them reaches a common cell in half
as many. A join on the cells finds them, and the bits are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import bound_batches, checked_broadcast, slices, strings
from stowline.llm.components import components
from stowline.sources.staging import most_rows, stage

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Bits of a segment, and of its count in a cell number.
SEGMENT, DIGIT = 4, 3
_SEGMENTS = 64 // SEGMENT
_SLICE = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text; zero if it has no words.

    A-Z are lower-cased; words are parted by ASCII white space; shingles count
    as often as they occur; fewer words than a shingle's are one shingle.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1:] or ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), _SLICE):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in
                           zip(starts[at:at + _SLICE], last[at:at + _SLICE])], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(last), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document; ``fp`` has the fingerprint's bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.int64))], ["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _point(fp: Column) -> Column:
    """Ones of each segment, as digits of one number."""
    ones = [F.shiftleft(F.bit_count(F.shiftright(fp, SEGMENT * s).bitwiseAND(F.lit(2 ** SEGMENT - 1))).cast("long"),
                        DIGIT * s) for s in range(_SEGMENTS)]
    return reduce(lambda a, b: a + b, ones)


def _beside(cell: Column) -> Column:
    """The cell and those one step away."""
    steps = [cell]
    for s in range(_SEGMENTS):
        digit = F.shiftright(cell, DIGIT * s).bitwiseAND(F.lit(2 ** DIGIT - 1))
        one = F.lit(1 << DIGIT * s).cast("long")
        steps += [F.when(digit < SEGMENT, cell + one), F.when(digit > 0, cell - one)]
    return F.filter(F.array(*steps), lambda c: c.isNotNull())


def near_fingerprints(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): distinct fingerprints (``fp``) with a < b that differ in 1 to ``max_bits`` bits; pairs may repeat."""
    cells = F.array(_point(F.col("fp")))
    for _ in range(-(-max_bits // 2)):
        cells = F.array_distinct(F.flatten(F.transform(cells, _beside)))
    placed = classes.select("fp", F.explode(cells).alias("cell"))
    a, b = placed.toDF("a", "cell"), placed.toDF("b", "cell")
    return a.join(b, "cell").filter(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    Documents link when their fingerprints differ in ``max_bits`` bits or fewer;
    ``component_id`` is the smallest doc_id reachable. Null, empty and blank
    texts have the fingerprint zero, linked like any other. Repeated rows stay
    rows; a null doc_id is in its component but never names it, unless the
    component has no other. Other columns are ignored.
    """
    marked = stage(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    named = stage(_components(marked, max_bits).select("fp", "component_id"), "named")
    return marked.join(checked_broadcast(named), "fp").select("doc_id", "fp", "component_id")


def _components(marked: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component, component_id) of each distinct fingerprint of ``marked`` (doc_id, fp).

    ``component`` is a fingerprint and tells components without any doc_id apart too.
    """
    classes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    pairs = stage(near_fingerprints(classes, max_bits).distinct(), "pairs") if max_bits else None
    if pairs is None or not most_rows(pairs):
        return classes.select("fp", F.col("fp").alias("component"), F.col("first").alias("component_id"))
    roots = stage(components(pairs), "roots")
    linked = roots.join(classes, F.col("node") == F.col("fp"))
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = linked.join(least, "component").select("fp", "component", "component_id")
    alone = classes.join(roots, F.col("node") == F.col("fp"), "left_anti").select(
        "fp", F.col("fp").alias("component"), F.col("first").alias("component_id"))
    return linked.unionByName(alone)


def _fingerprint_column(docs: DataFrame, text: str, shingle: int) -> Column:
    """The fingerprint of each whole text, as a signed long."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.array([fingerprint(t, shingle) for t in strings(texts)], np.uint64)
            yield pa.array(found.astype(np.int64))

    return run(F.col(text))


def keep_firsts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one, that with the smallest doc_id.

    All columns stay. Rows are judged by their own texts: a doc_id repeated with
    other texts has a row in each component it is in, and each component is
    judged for itself. Null doc_ids come last. Of a component's rows with one
    doc_id, that with the smallest text stays, then by the other columns.
    """
    # A row travels as one column, so that the names of its own columns don't matter.
    names = [f"`{c}`" for c in docs.columns]
    own_id, own_text = F.col(f"_row.`{doc_id}`").cast("long"), F.col(f"_row.`{text}`")
    marked = stage(docs.select(F.struct(*names).alias("_row"), _fingerprint_column(docs, text, shingle).alias("_fp")),
                   "marked")
    named = stage(_components(marked.select(own_id.alias("doc_id"), F.col("_fp").alias("fp")),
                              max_bits).toDF("_fp", "_component", "_least"), "named")
    firsts = marked.join(checked_broadcast(named), "_fp").filter(own_id.eqNullSafe(F.col("_least")))
    ties = stage(firsts.groupBy("_component").count().filter("count > 1").select(
        F.col("_component").alias("_tied")), "ties")
    if not most_rows(ties):
        return firsts.select("_row.*")
    on = F.col("_component") == F.col("_tied")
    once = firsts.join(checked_broadcast(ties), on, "left_anti").select("_row.*")
    least = firsts.join(checked_broadcast(ties), on, "left_semi").groupBy("_component").agg(
        F.min_by("_row", F.struct(F.coalesce(own_text, F.lit("")), *[
            F.col(f"_row.{c}") for c in names if c != f"`{text}`"])).alias("_row"))
    return once.unionByName(least.select("_row.*"))
