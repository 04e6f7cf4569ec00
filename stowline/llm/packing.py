"""Packing token ids into sequences by concatenating and cutting.

Documents follow each other in one long line of ids that is cut into windows of a
fixed size. The first pass encodes each document once and places it within its
part of the corpus by a running sum; the second adds the parts' own prefix
sums, so that every document knows its place in the whole line, and cuts it at
multiples of the window. Nothing is shuffled, and only the last window is short.

A window that ends in the next part has pieces in both: its boundary records.
:func:`sequences` puts whole windows together where they lie, and only boundary
records meet in a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowline.llm.common import slices, text_batches
from stowline.llm.token_files import encoder
from stowline.sources.staging import stage

WINDOW = 2048
#: Ids of one document cut at a time; a multiple of nothing in particular.
AT_ONCE = 1 << 20

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("part", pa.int32()), ("ids", pa.binary())])
_PIECE_SQL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "part int, ids binary")


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, window: int = WINDOW, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """The pieces of all documents, one row each.

    ``doc_id``; ``start``, the document's ids before the piece; ``length``;
    ``ids_crc32`` of its ids as little-endian unsigned 32-bit numbers; ``doc_tokens``,
    the document's ids with ``end_id``; ``sequence_id``; ``offset`` in the sequence;
    ``part`` of the corpus; ``ids``, as the checksum reads them. The library is not
    asked for special tokens.

    A null or empty text has the end id alone. Repeated rows and rows without an
    id are documents of their own. Texts of any length are encoded whole. Other
    columns are ignored. No rows give no pieces.
    """
    with text_batches(docs.sparkSession):
        tokens = stage(_placed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")),
                               tokenizer_file, end_id), "placed")
    # One row per part.
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = tokens.groupBy("part").agg(F.sum("n").alias("_n")).select(
        "part", F.coalesce(before, F.lit(0)).alias("before"))
    line = tokens.join(F.broadcast(parts), "part").select(
        "part", "doc_id", (F.col("before") + F.col("at")).alias("at"), "n", "width", "ids")
    return line.mapInArrow(lambda batches: _cut(batches, window), _PIECE_SQL)


def _placed(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """(part, doc_id, at, n, width, ids): ``at`` counts the ids before in the same part, ids have ``width`` bytes."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()),
                        ("width", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_file)
        width = 2 if max(known.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            found = known.encode([t or "" for t in batch.column(1).to_pylist()])
            n = np.array([len(ids) // 4 + 1 for ids in found], np.int64)
            ends = at + np.cumsum(n)
            narrow = [np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + end for ids in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(ends - n), pa.array(n),
                 pa.array(np.full(len(n), width, np.int32)), pa.array(narrow, pa.binary())], schema=schema)
            at = int(ends[-1])

    return docs.mapInArrow(run, "part int, doc_id long, at long, n long, width int, ids binary")


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The documents (part, doc_id, at, n, width, ids) cut at multiples of ``window``."""
    def send(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE, strict=True)],
                                          schema=_PIECE)

    for batch in slices(batches):
        rows, held = [], 0
        for part, doc, at, n, width, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.frombuffer(raw, f"<u{width}")
            start = 0
            while start < n:
                sequence, offset = divmod(at + start, window)
                length = min(n - start, window - offset)
                piece = ids[start:start + length].astype("<u4").tobytes()
                rows.append((doc, start, length, zlib.crc32(piece), n, sequence, offset, part, piece))
                start += length
                held += length
                if held >= AT_ONCE:
                    yield send(rows)
                    rows, held = [], 0
        if rows:
            yield send(rows)


def sequences(pieces: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces) of the sequences that ``pieces`` of :func:`pack` make up.

    ``ids`` are little-endian unsigned 32-bit numbers, padded by ``pad_id`` to the
    window unless their number is a power of two. ``pieces`` holds (offset,
    length, doc_id, start) in order. Windows that lie in one part and are read
    by one task are put together there; the rest meet by sequence.
    """
    schema = "sequence_id long, n_tokens long, ids binary, pieces array<struct<offset:long,length:long,doc_id:long,start:long>>"
    wanted = pieces.select("sequence_id", "offset", "length", "doc_id", "start", "ids")
    local = stage(wanted.mapInArrow(lambda batches: _joined(batches, window), "whole boolean, " + schema), "windows")
    split = local.filter("not whole").groupBy("sequence_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct(
            F.col("pieces")[0]["offset"].alias("offset"), "ids", "pieces"))).alias("_p")).select(
        "sequence_id", "n_tokens", F.aggregate("_p", F.lit(b""), lambda done, x: F.concat(done, x["ids"])).alias("ids"),
        F.flatten("_p.pieces").alias("pieces"))
    done = local.filter("whole").drop("whole").unionByName(split)
    n = F.col("n_tokens")
    full = F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(window)
    pad = F.lit(np.array([pad_id], "<u4").tobytes().hex())
    padded = F.concat("ids", F.unhex(F.repeat(pad, (full - n).cast("int"))))
    return done.withColumn("ids", padded)


def _joined(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Runs of pieces of one sequence that follow each other, and whether they fill its window."""
    names = ["whole", "sequence_id", "n_tokens", "ids", "pieces"]
    piece = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.list_(piece)]
    now: list[tuple] = []
    done: list[tuple] = []

    def close() -> None:
        n = sum(p[2] for p in now)
        done.append((n == window, now[0][0], n, b"".join(p[5] for p in now),
                     [dict(zip(("offset", "length", "doc_id", "start"), p[1:5])) for p in now]))

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names)

    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now and (row[0] != now[-1][0] or row[1] != now[-1][1] + now[-1][2]):
                close()
                now = []
            now.append(row)
        if len(done) >= 500:
            yield send()
            done = []
    if now:
        close()
    if done:
        yield send()
