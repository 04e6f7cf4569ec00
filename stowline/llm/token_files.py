"""Token ids of whole documents in bit-plane files.

Ids lie in ascending document order. They are cut into blocks of a fixed number
of ids; a block's ids are transposed into byte or bit planes and each plane is
compressed by zstandard on its own, since the planes of high bits hardly vary.
With its planes a block stores the chunk index: the documents that have ids in
it, where they begin, and how many ids they have. A block can be read alone.

The files are Parquet files of such blocks, so that Spark's commit protocol
keeps them whole when executors are lost, on any file system.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowline.llm.common import slices, text_batches
from stowline.sources.staging import stage

BLOCK_IDS = 65_536
#: Words remembered by a worker; frequent ones survive a change of generation.
REMEMBERED = 500_000
_TOGETHER = 100

#: Texts of these characters are lower-cased and split into words alike everywhere and are in normal form C.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]*")
_SPACE, _LETTER = " \t\n\r\x0b\x0c", "a-zß-öø-ÿ"
#: The pre-tokeniser's pattern for such texts in lower case; fixed value of the vocabulary file.
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_SPACE}0-9{_LETTER}]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids by the tokenizers library, asked once for each distinct part of a text.

    The pre-tokeniser parts texts for good in this kind of vocabulary. Words of
    plain characters are parted by its own pattern here, words that are not go
    to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        first = spec["pre_tokenizer"]["pretokenizers"][0]
        if (first["pattern"].get("Regex") != _PATTERN or not first["invert"]
                or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])):
            raise ValueError("not a vocabulary of lower-cased words parted by white space")
        self.added = [t["content"].lower() for t in spec["added_tokens"]]
        suffix = spec["model"]["end_of_word_suffix"]
        vocabulary = self.library.get_vocab()
        self.word_ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._fresh: dict[str, bytes] = {}
        self._kept: dict[str, bytes] = {}

    def _lowered(self, text: str) -> str | None:
        """The text in lower case; None if it is not plain or might hold an added token."""
        if _PLAIN.fullmatch(text):
            text = text.lower()
            if not any(t in text for t in self.added):
                return text
        return None

    def _ask(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that are one pre-token each, asked many in one text."""
        asked: dict[str, bytes] = {}
        texts = [parts[start:start + _TOGETHER] for start in range(0, len(parts), _TOGETHER)]
        found = self.library.encode_batch_fast([" ".join(some) for some in texts], add_special_tokens=False)
        for some, encoding in zip(texts, found, strict=True):
            ids = np.array(encoding.ids, np.uint32)
            ends = np.flatnonzero(self.word_ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError(f"the library parts these otherwise: {some[:20]}")
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            asked.update((part, raw[a:b]) for part, a, b in zip(some, [0, *ends], ends))
        return asked

    def _learn(self, words: list[str]) -> None:
        """Ids of new plain words in lower case."""
        cut = {word: _PARTS.findall(word) for word in words if not word.isalpha()}
        parts = set(chain.from_iterable(cut.values())).difference(self._fresh)
        parts.update(filter(str.isalpha, words))
        older = self._kept.keys() & parts
        self._fresh.update((part, self._kept[part]) for part in older)
        self._fresh.update(self._ask(list(parts - older)))
        known = self._fresh.__getitem__
        self._fresh.update((word, b"".join(map(known, own))) for word, own in cut.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self._fresh) > REMEMBERED:
            self._fresh, self._kept = {}, self._fresh
        cut, wholes = [], set()
        for text in texts:
            plain = self._lowered(text)
            if plain is not None:
                cut.append(plain.split())
                continue
            words = []
            for word in text.replace("\n", " ").split(" "):
                plain = self._lowered(word)
                if plain is None:
                    wholes.add(word)
                    words.append(word)
                else:
                    words += plain.split()
            cut.append(words)
        new = set(chain.from_iterable(cut)).difference(self._fresh)
        older = self._kept.keys() & new
        self._fresh.update((word, self._kept[word]) for word in older)
        new -= older
        whole = list(new & wholes)
        self._learn(list(new.difference(wholes)))
        for word, found in zip(whole, self.library.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            self._fresh[word] = np.array(found.ids, np.uint32).tobytes()
        known = self._fresh.__getitem__
        return [b"".join(map(known, words)) for words in cut]


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return _encoders[tokenizer_file]


def planes_of(ids: np.ndarray, unit: str) -> list[bytes]:
    """The ids' planes, lowest first: 4 of bytes or 32 of bits, each compressed; zero planes are empty."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        planes = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little") for k in range(32)]
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(p.tobytes()) if p.any() else b"" for p in planes]


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    """The inverse of :func:`planes_of`."""
    unpack = zstandard.ZstdDecompressor()
    if len(planes) == 4:
        raw = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                raw[:, k] = np.frombuffer(unpack.decompress(plane), np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                bits[:, k] = np.unpackbits(np.frombuffer(unpack.decompress(plane), np.uint8),
                                           count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int | None, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(doc_id, ids): each whole text's ids and the end id, packed as little-endian uint32.

    Null and empty texts have the end id only. The library is not asked for
    special tokens.
    """
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file).encode
        for batch in slices(batches):
            found = [ids + tail for ids in encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, ids binary")


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int32()),
                    ("planes", pa.list_(pa.binary())), ("doc_ids", pa.list_(pa.int64())),
                    ("at", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_BLOCK_SQL = ("part int, block long, first long, n_ids int, planes array<binary>, doc_ids array<long>, "
              "at array<long>, lengths array<long>")


def write_ids(tokens: DataFrame, path: str, unit: str = "byte", block_ids: int = BLOCK_IDS) -> None:
    """Write (doc_id, ids) in ascending ``doc_id`` order as bit-plane files under ``path``.

    A null doc_id comes first. Rows of one doc_id follow each other by the hash of
    their ids, and a much repeated doc_id is shared by several tasks. Each
    task writes the documents of one range, block by block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting, used, held, seen, block = deque(), 0, 0, 0, 0
        index: list[tuple[int | None, int, int]] = []

        def row(ids: np.ndarray, docs: list) -> pa.RecordBatch:
            columns = [[part], [block], [block * block_ids], [len(ids)], [planes_of(ids, unit)], *([list(c)] for c in zip(*docs))]
            columns += [[[]]] * (8 - len(columns))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _unpacked(raw)
                index.append((doc, seen, len(ids)))
                waiting.append(ids)
                held += len(ids)
                seen += len(ids)
                while held >= block_ids:
                    taken, missing = [], block_ids
                    while missing:
                        some = waiting[0][used:used + missing]
                        taken.append(some)
                        missing, used = missing - len(some), used + len(some)
                        if used == len(waiting[0]):
                            waiting.popleft()
                            used = 0
                    end = (block + 1) * block_ids
                    yield row(np.concatenate(taken), [d for d in index if d[1] < end])
                    index = [d for d in index if d[1] >= end or d[1] + d[2] > end]
                    held, block = held - block_ids, block + 1
        if held or index:
            rest = list(waiting)
            rest[:1] = [ids[used:] for ids in rest[:1]]
            yield row(np.concatenate([np.zeros(0, "<u4"), *rest]), index)

    with text_batches(tokens.sparkSession):
        tokens = stage(tokens.select("doc_id", "ids").mapInArrow(_pack, "doc_id long, ids binary"), "tokens")
    by = ["doc_id", F.xxhash64("ids")]
    ordered = tokens.repartitionByRange(*by).sortWithinPartitions(*by, "ids")
    ordered.mapInArrow(run, _BLOCK_SQL).write.option("compression", "uncompressed").parquet(path)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's ids as compressed byte planes, for the way to its file."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches):
        packed = [squeeze.compress(np.frombuffer(raw, np.uint8).reshape(-1, 4).T.tobytes())
                  for raw in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "ids"])


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in files under ``path``.

    ``start`` counts the ids of all documents before. Every block is read where
    it lies; only documents that go on from one block to the next are put
    together by a shuffle of their pieces.
    """
    blocks = spark.read.schema(_BLOCK_SQL).parquet(path)
    # One row per file.
    starts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(
        F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    schema = "part int, doc_id long, at long, n_tokens long, block long, ids binary"
    whole = blocks.mapInArrow(lambda batches: _documents(batches, True), schema).drop("block")
    pieces = blocks.mapInArrow(lambda batches: _documents(batches, False), schema)
    keys = ["part", "doc_id", "at", "n_tokens"]
    joined = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "ids"))).alias("_p")).select(
        *keys, F.aggregate("_p", F.lit(b""), lambda done, piece: F.concat(done, piece["ids"])).alias("ids"))
    return whole.unionByName(joined).join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids")


def _documents(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Documents that lie in one block, or else the pieces of those that do not."""
    names = ["part", "doc_id", "at", "n_tokens", "block", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for at in range(batch.num_rows):
            block = batch.slice(at, 1).to_pylist()[0]
            docs = list(zip(block["doc_ids"], block["at"], block["lengths"], strict=True))
            first, end = block["first"], block["first"] + block["n_ids"]
            wanted = [d for d in docs if (d[1] >= first and d[1] + d[2] <= end) == whole]
            if not wanted:
                continue
            ids = ids_of(block["planes"], block["n_ids"])
            rows = [(block["part"], doc, start, length, block["block"],
                     ids[max(start, first) - first:min(start + length, end) - first].tobytes())
                    for doc, start, length in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
