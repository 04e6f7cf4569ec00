"""SentencePiece merge-type (BPE) models: encoding by a score-ordered agenda, and decoding.

A text becomes symbols, one per character. The agenda holds adjacent pairs whose
union is a piece, best score first, then leftmost; the best pair merges until
none is left. No piece holds a space mark after another character, nor a line
break, so a text falls into chunks that cannot merge with each other. Tasks
encode each distinct chunk once and check it against the sentencepiece library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowline.llm.common import bound_batches, slices

SPACE = "▁"
_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
_BREAK = "\n"
#: Chunks remembered by a worker; frequent ones survive a change of generation.
REMEMBERED = 80_000
UNKNOWN_TEXT = " ⁇ "
#: Chunks up to this length are encoded together, so many at a time.
_SHORT, _TOGETHER = 40, 4096
_BASE = 1 << 22
_FOREIGN = 1 << 21  # plus the code point: a character that is no piece
_NONE = 1 << 40


class PieceModel:
    """Pieces of a merge-type vocabulary, with the agenda and the decoder."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        _require_plain_merges(self.library)
        lib, n = self.library, self.library.get_piece_size()
        self.unknown = lib.unk_id()
        self.bytes = [i for i in range(n) if lib.is_byte(i)]
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i)} | set(self.bytes)
        pieces = [lib.id_to_piece(i) for i in range(n)]
        if any(_BREAK in p or SPACE in p.lstrip(SPACE) for i, p in enumerate(pieces) if i not in special):
            raise ValueError("a piece spans a space or line break; texts cannot be cut there")
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.raw = [b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for value, i in enumerate(self.bytes):
            self.raw[i] = bytes([value])
        self.raw[self.unknown] = UNKNOWN_TEXT.encode()
        self.marked = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        self._fresh: dict[str, bytes] = {}
        self._kept: dict[str, bytes] = {}
        self._lead = lib.encode(_BREAK)
        self._pairs()
        self._break = self._finish([self.of_point[ord(_BREAK)].item()])

    def _pairs(self) -> None:
        """Every pair of symbols whose union is a piece: sorted keys, the union, and its rank by score."""
        symbols = dict(self.ids)
        for piece in self.ids:
            for character in piece:
                symbols.setdefault(character, _FOREIGN + ord(character))
        self.symbols = symbols
        self.of_point = np.arange(0x110000) + _FOREIGN
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_point[ord(piece)] = i
        rank = {score: at for at, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        rows = sorted((symbols[piece[:cut]] * _BASE + symbols[piece[cut:]], i, rank[self.scores[piece]])
                      for piece, i in self.ids.items() for cut in range(1, len(piece))
                      if piece[:cut] in symbols and piece[cut:] in symbols)
        self.keys, self.unions, self.ranks = (np.array(c, np.int64) for c in zip(*rows, strict=True))

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``_NONE`` if the pair is no piece) and union of each pair of symbols."""
        keys = left * _BASE + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE), self.unions[at]

    def merge_many(self, chunks: list[str]) -> list[bytes]:
        """Ids (packed int32) of short chunks of like length, each with an agenda of its own.

        A row holds a chunk's symbols from the left, and the ranks of its
        adjacent pairs are its agenda: every round takes each row's best pair,
        the leftmost of equals, and renews the two pairs beside the union.
        """
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        width = int(lengths.max())
        codes = np.full((len(chunks), width + 1), -1, np.int64)
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        codes[np.arange(width + 1) < lengths[:, None]] = self.of_point[points]
        ranks, unions = self._look_up(codes[:, :-1], codes[:, 1:])
        rows = np.arange(len(chunks))
        columns = np.arange(width + 1)
        while True:
            best = ranks.argmin(axis=1)
            rows = rows[ranks[np.arange(len(ranks)), best] < _NONE]
            if not len(rows):
                break
            live = ranks[np.arange(len(ranks)), best] < _NONE
            ranks, unions, best = ranks[live], unions[live], best[live]
            at = np.arange(len(rows))
            own = codes[rows]
            own[at, best] = unions[at, best]
            # close the gap right of the union, in symbols and in pairs
            shift = np.minimum(columns + (columns > best[:, None]), width)
            own = np.take_along_axis(own, shift, 1)
            own[:, -1] = -1
            codes[rows] = own
            pair = shift[:, :-1].clip(max=width - 1)
            ranks, unions = np.take_along_axis(ranks, pair, 1), np.take_along_axis(unions, pair, 1)
            ranks[:, -1] = _NONE
            ranks[at, best], unions[at, best] = self._look_up(own[at, best], own[at, best + 1])
            left = np.maximum(best - 1, 0)
            again, union = self._look_up(own[at, left], own[at, left + 1])
            ranks[at, left], unions[at, left] = again, union
        ends = np.cumsum((codes >= 0).sum(axis=1)) * 4
        raw = codes[codes >= 0].astype(np.int32).tobytes()
        out = [raw[start:end] for start, end in zip([0, *ends[:-1]], ends, strict=True)]
        for row in np.nonzero((codes >= len(self.raw)).any(axis=1))[0]:
            out[row] = self._finish([c for c in codes[row].tolist() if c >= 0])
        return out

    def merge(self, chunk: str) -> bytes:
        """Ids (packed int32) of one chunk of any length, by a heap of its adjacent pairs."""
        symbols = list(chunk)
        before = list(range(-1, len(symbols) - 1))
        after = list(range(1, len(symbols) + 1))
        agenda: list[tuple[float, int, int, int]] = []
        scores = self.scores

        def offer(left: int, right: int) -> None:
            pair = symbols[left] + symbols[right]
            score = scores.get(pair)
            if score is not None:
                heappush(agenda, (-score, left, right, len(pair)))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, length = heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != length:
                continue  # one of the two has merged with another since
            symbols[left] += symbols[right]
            symbols[right] = ""
            beyond = after[right]
            after[left] = beyond
            if beyond < len(symbols):
                before[beyond] = left
                offer(left, beyond)
            if before[left] >= 0:
                offer(before[left], left)
        return self._finish([self.symbols.get(s) or _FOREIGN + ord(s) for s in symbols if s])

    def _finish(self, symbols: list[int]) -> bytes:
        """Packed ids; characters outside the vocabulary become bytes or the unknown id."""
        out: list[int] = []
        for symbol in symbols:
            if symbol < len(self.raw):
                out.append(symbol)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(symbol - _FOREIGN).encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # neighbouring unknown characters are one id
        return np.array(out, np.int32).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Encode chunks not met lately, and hold them against the library."""
        if len(self._fresh) > REMEMBERED:
            self._fresh, self._kept = {}, self._fresh
        new: dict[int, list[str]] = {}
        for chunk in chunks:
            if chunk not in self._fresh:
                ids = self._kept.get(chunk)
                if ids is None:
                    new.setdefault((len(chunk) + 3) // 4 if len(chunk) <= _SHORT else 0, []).append(chunk)
                else:
                    self._fresh[chunk] = ids
        for size, some in new.items():
            for start in range(0, len(some), _TOGETHER):
                part = some[start:start + _TOGETHER]
                found = self.merge_many(part) if size else [self.merge(c) for c in part]
                self._check(part, found)
                self._fresh.update(zip(part, found, strict=True))

    def _check(self, chunks: list[str], found: list[bytes]) -> None:
        """The library must give the same ids for the chunks, parted by line breaks."""
        theirs = self.library.encode(_BREAK + _BREAK.join(chunks), num_threads=1)[len(self._lead):]
        if self._break.join(found) != np.array(theirs, np.int32).tobytes():
            raise ValueError(f"the library encodes one of these otherwise: {chunks[:20]}")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [_CHUNKS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self._learn(set(chain.from_iterable(cut)))
        known = self._fresh.__getitem__
        return [np.frombuffer(b"".join(map(known, chunks)), np.int32) for chunks in cut]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        if next((i for i in ids if self.raw[i]), None) in self.marked:
            raw = raw[1:]  # the space that encoding puts before a text
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        """Byte runs that are no UTF-8: each byte outside a valid character is U+FFFD."""
        is_byte, out, run, begun = set(self.bytes), [], b"", False
        for i in [*ids, -1]:
            if i in is_byte:
                run += self.raw[i]
                begun = True
                continue
            while run:
                size = next((k for k in range(min(4, len(run)), 0, -1) if _is_character(run[:k])), 0)
                out.append(run[:size].decode() if size else "�")
                run = run[size or 1:]
            if i >= 0:
                piece = self.raw[i].decode()
                out.append(piece if begun or i not in self.marked else piece[1:])
                begun = begun or bool(piece)
        return "".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def _require_plain_merges(library: sentencepiece.SentencePieceProcessor) -> None:
    """Only models whose text is taken as it is (identity normaliser, dummy prefix)."""
    model = _fields(library.serialized_model_proto())
    normaliser, trainer = _fields(model[3][0]), _fields(model[2][0])
    kinds = {_fields(p).get(3, [1])[0] for p in model[1]}
    plain = (trainer.get(3) == [2] and normaliser.get(1) == [b"identity"]
             and normaliser.get(3, [1]) == [1] and normaliser.get(4, [1]) == [0]
             and not kinds & {4, 5})  # user-defined and unused pieces
    if not plain:
        raise ValueError("not a merge-type model with identity normalisation and a dummy prefix")


def _fields(message: bytes) -> dict[int, list]:
    """Field values of a protobuf message by field number."""
    found: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            value = message[at:at + size]
            at += size
        found.setdefault(key >> 3, []).append(value)
    return found


_models: dict[str, PieceModel] = {}


def model(model_file: str) -> PieceModel:
    """The worker's copy of a model; its remembered chunks serve all later batches."""
    if model_file not in _models:
        _models[model_file] = PieceModel(model_file)
    return _models[model_file]


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``ids`` (array of int) of each whole text, and ``decoded``, the ids' text.

    ``model_file`` is a path that every executor can open. Null and empty texts
    have no ids and the empty decoded text. Repeated rows give equal rows; other
    columns are ignored. A chunk that the library encodes otherwise stops the job.
    """
    kept = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                           T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_file)
        for batch in slices(batches):
            encoded = pieces.encode([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            decoded = pa.array([pieces.decode(ids.tolist()) for ids in encoded], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], _lists(encoded), decoded], [*batch.schema.names[:-1], "ids", "decoded"])

    bound_batches(kept.sparkSession)
    return kept.mapInArrow(run, schema)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)))


def decode_ids(rows: DataFrame, model_file: str, ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``decoded`` of id lists from elsewhere; a null list decodes to the empty text."""
    kept = rows.select(*keep, F.col(ids).alias("_ids"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_file)
        for batch in slices(batches):
            decoded = [pieces.decode(i or []) for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(decoded, pa.string())],
                                             [*batch.schema.names[:-1], "decoded"])

    bound_batches(kept.sparkSession)
    return kept.mapInArrow(run, schema)


def ids_sha256(ids: Column) -> Column:
    """Hex digest of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256)
