"""Phrase collocations by the stripes pattern.

A stripe is one prefix (one to four words) with an associative counter of the
words that follow it. Tasks count stripes locally, flush them at a bounded size
as blocks, one for each hash of prefixes, and the stripes of a block are merged elementwise
as its parts stream out of a sorted shuffle. So the rows shuffled are those of tasks and blocks, not
of tasks and prefixes, which both grow with the corpus. The merged stripes give the counts of all extensions, which are the
totals of the prefixes one word longer, and the largest extension of each
prefix, which decides subsumption.

A phrase is frequent only if all phrases in it are, so the corpus is read
four times. Words are counted first: that is the stripe of the empty prefix. Then
hashes of pairs of words that may be frequent are counted, over whole batches of
bytes at once, and hashes of triples of such pairs. Stripes hold what may be
frequent by then. "May be" is a Bloom filter
of bounded size: it lets strangers through, as equal hashes do, and the exact
counts of the stripes drop them; it never loses a phrase.

Hot prefixes are split: a prefix whose first word is more than one ``1 / HOT``-th of all
words gets slots by the hash of the next word. There can be at most ``HOT`` such
words, so their list can be sent to all tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowline.llm.common import checked_broadcast, slices, text_batches
from stowline.operators.bloom import blocks_for, bloom_blocks
from stowline.sources.staging import measures_of, most_rows, stage

MOST_WORDS = 5
#: Phrases of up to so many words are filtered by the counts of their hashes.
HASHED_WORDS = 3
#: Counter entries a task holds before it sends them on, and words between two looks at their number.
HELD, LOOK = 500_000, 50_000
#: Hashes of pairs or triples a task holds before it sends their counts on.
PAIRS = 4_000_000
#: A prefix above this share of all words is split, into so many slots a share.
HOT, SLOTS = 1000, 4
#: Pairs and triples that may be frequent for each block of stripes, which a task merges at a time.
BLOCK = 4096
#: Candidates of one language ranked in one task of the first round.
RANKED = 200_000

# The separators of pieces become line feeds, the other blanks spaces, A-Z lower case; bytes of UTF-8.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
# Stripes of a block: prefixes a line each, slots as 32-bit numbers, words that follow a prefix joined by
# spaces, a line for each prefix, and all their counts as 64-bit numbers. No word has a line feed or a space.
_BLOCK = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("prefixes", pa.binary()), ("slots", pa.binary()),
                    ("next", pa.binary()), ("counts", pa.binary())])
_BLOCK_SQL = "lang string, block int, prefixes binary, slots binary, next binary, counts binary"
Stripes = dict[bytes, dict[bytes, int]]


def collocations(docs: DataFrame, at_least: int = 100, first: int = 2000, covered: int = 100,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by score.

    Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and the
    control characters LF to CR, pieces into words at spaces and tabs.
    Candidates are phrases of 2 to 5 words with at least ``at_least``
    occurrences ``a`` within pieces. ``n`` counts the language's words, ``l`` and
    ``r`` the two parts of the lowest-scoring cut; score is
    ``floor(1000 a n / (l r))``, ties of cuts go to the shorter first part. A
    candidate is dropped if a longer candidate contains it and has at least
    ``covered`` percent of its occurrences.

    A null text is empty, a null language is ``und``; repeated rows count again;
    texts of any length are counted whole. Other columns are ignored. No
    candidates, or no rows, give an empty table.
    """
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    with text_batches(docs.sparkSession):
        words = stage(_count_words(docs), "words", words=F.sum("n"))
        often = stage(words.filter(F.col("n") >= at_least).select("lang", F.col("word").alias("phrase"), "n"), "often")
        frequent = _filter(stage(often.select("lang", "phrase").mapInArrow(_hashed, "h long"), "hashes"))
        filters, maybe = [frequent], 0
        for _ in range(2, HASHED_WORDS + 1):
            hashes = stage(_count_hashes(docs, filters).filter(F.col("n") >= at_least).select("h"), "hashes")
            filters.append(_filter(hashes))
            maybe += most_rows(hashes)
        slots = _slots(often, measures_of(words)["words"] or 0)
        blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-maybe // BLOCK))
        stripes = _merged(_stripes(docs, filters, slots, blocks), at_least)

    phrases = stage(_extensions(stripes), "phrases")
    lengths = words.groupBy("lang").agg(F.sum("n").alias("n"))  # one row per language
    scored = _scored(phrases, often, lengths)
    kept = scored.join(_subsumed(phrases, stripes, covered), ["lang", "phrase"], "left_anti")
    return _ranked(kept, most_rows(phrases), first)


def _count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        seen = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()),
                     pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for lang, raw in _texts(batches):
            words = raw.translate(_FOLD).split()
            for start in range(0, len(words), LOOK):
                some = words[start:start + LOOK]
                held.setdefault(lang, Counter()).update(some)
                seen += len(some)
                if seen >= LOOK:
                    seen = 0
                    if sum(map(len, held.values())) >= HELD:
                        yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy(
        "lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in slices(batches, 64):
        yield from zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)


# Hashing. Only filters depend on hashes, so equal ones cost time, never results.

#: Bytes of a word that its hash sees beside its length, and bytes hashed at a time.
HASHED, STRETCH = 4096, 1 << 20
_BASE, _MIX, _NEXT = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_CLASS = np.frombuffer(bytes(1 if c in b" \t" else 2 if c in b".,;:!?\n\x0b\x0c\r" else 0 for c in range(256)), np.uint8)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    size = STRETCH + HASHED
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))])
                 for base in (_BASE, pow(_BASE, -1, 1 << 64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_NEXT)
    return h ^ (h >> np.uint64(31))


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word of the bytes, the same wherever the word lies; starts ascend."""
    powers, inverse = _powers()
    out = (ends - starts).astype(np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, (int(starts[-1]) if len(starts) else 0) + STRETCH + 1, STRETCH))
    for a, b in pairwise(cuts):
        if a == b:
            continue
        base = starts[a]
        stops = np.minimum(ends[a:b], starts[a:b] + HASHED) - base
        terms = (folded[base:base + stops[-1]].astype(np.uint64) + np.uint64(1)) * powers[:stops[-1]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        own = starts[a:b] - base
        out[a:b] += (sums[stops] - sums[own]) * inverse[own]
    return _mixed(out)


def _lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of (lang, word)."""
    for batch in slices(batches, 10_000):
        raw, offsets = _bytes_of(batch.column(1).cast(pa.binary()))
        langs = np.array(list(map(_lang_hash, batch.column(0).to_pylist())), np.uint64)
        h = _mixed(word_hashes(raw, offsets[:-1], offsets[1:]) + langs)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without nulls, and where its values begin and end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    values = texts.buffers()[2]
    raw = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


class _Words:
    """All words of a batch of texts: their places, and what may be frequent from the filters so far.

    ``may_be[k]`` tells for each word whether the phrase of k + 1 words that begins
    there lies in one piece and may be frequent; ``hashes`` are those of the phrases one word longer than
    the filters know, and ``open`` those of which both parts may be frequent.
    """

    def __init__(self, batch: pa.RecordBatch, filters: list["Maybe"]):
        raw, offsets = _bytes_of(batch.column("text"))
        kind = _CLASS[raw]
        self.folded = _LOWER[raw]
        inside = kind == 0
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(raw))]  # texts end words
        begins[edges] = inside[edges]
        finishes[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        # Both numbers never fall, so their sum is equal only if both are.
        piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts) + self.text
        self.langs = batch.column("lang").to_pylist()
        lang = np.array([_lang_hash(x) for x in self.langs], np.uint64)[self.text]
        words = word_hashes(self.folded, self.starts, self.ends)
        self.hashes, self.open = _mixed(words + lang), np.ones(len(words), bool)
        self.may_be = []
        for size, asked in enumerate(filters, 1):
            self.open[self.open] = asked(self.hashes[self.open])
            self.may_be.append(self.open)
            self.hashes = _mixed(self.hashes[:-1] * np.uint64(_BASE) + words[size:] * np.uint64(_NEXT))
            self.open = self.open[1:] & self.open[:-1] & (piece[size:] == piece[:len(piece) - size])


class Maybe:
    """A Bloom filter of hashes asked from numpy; the bits come from Spark's broadcast."""

    def __init__(self, sent, blocks: int):
        self.sent, self.blocks = sent, blocks

    def __call__(self, h: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.sent.value, np.uint64)[((h >> np.uint64(32)) & np.uint64(self.blocks - 1)).astype(np.int64)]
        found = bits >> (h & np.uint64(63))
        for k in (6, 12, 18):
            found &= bits >> ((h >> np.uint64(k)) & np.uint64(63))
        return (found & np.uint64(1)).astype(bool)


def _filter(hashes: DataFrame) -> Maybe:
    """The filter of a staged table (h); at most ``spark.stowline.bloomBlocks`` numbers are sent."""
    spark = hashes.sparkSession
    blocks = blocks_for(spark, most_rows(hashes))
    table = bloom_blocks(hashes, F.col("h"), blocks).toArrow()
    bits = np.zeros(blocks, np.int64)
    bits[table.column("block").to_numpy()] = table.column("bits").to_numpy()
    return Maybe(spark.sparkContext.broadcast(bits.tobytes()), blocks)


def _count_hashes(docs: DataFrame, filters: list[Maybe]) -> DataFrame:
    """(h, n): how often each hash of a phrase one word longer occurs, if its parts may be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            words = _Words(batch, filters)
            held.append(words.hashes[words.open])
            size += len(held[-1])
            if size >= PAIRS:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _slots(often: DataFrame, total: int) -> dict[tuple[str, bytes], int]:
    """Slots of the prefixes that begin with a hot word, by (lang, word); there are at most ``HOT``."""
    share = total // HOT + 1
    return {(lang, phrase.encode()): min(SLOTS * -(-n // share), 1 << 15)
            for lang, phrase, n in often.filter(F.col("n") > share).collect()}


def _stripes(docs: DataFrame, filters: list[Maybe], slots: dict[tuple[str, bytes], int], blocks: int) -> DataFrame:
    """(lang, prefix, next, counts): stripes of what may be frequent, a hot prefix with a row for each of its slots.

    They are shuffled in ``blocks`` by the hash of prefix and slot, and a block's parts merged elementwise.
    """
    sent = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        held: dict[str, Stripes] = {}
        seen = 0
        for batch in batches:
            words = _Words(batch, filters)
            pairs = words.may_be[1]
            # The longest phrase that ends with each pair's second word: as long as all its triples may be frequent.
            longest = np.where(pairs, 2, 0)
            longer = words.may_be[2]
            for size in range(3, MOST_WORDS + 1):
                longest[size - 2:][longer] = size
                longer = longer[1:] & longer[:-1]
            text = words.folded.tobytes()
            edge = np.diff(np.concatenate([[False], pairs, [False]]).astype(np.int8))
            # Runs of pairs: from the first word to the last.
            for first, last in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                stripes = held.setdefault(words.langs[words.text[first]], {})
                for start in range(first, last, LOOK):
                    begin, end = max(first, start - MOST_WORDS + 2), min(last, start + LOOK)
                    run_ = [text[a:b] for a, b in zip(words.starts[begin:end + 1].tolist(), words.ends[begin:end + 1].tolist())]
                    _count_run(run_, start - begin, longest[start:end].tolist(), stripes)
                    seen += end - start
                    if seen >= LOOK:
                        seen = 0
                        if sum(sum(map(len, s.values())) for s in held.values()) >= HELD:
                            yield from _sent(held, hot, blocks)
        yield from _sent(held, hot, blocks)

    keys = ["lang", "block"]
    return docs.mapInArrow(run, _BLOCK_SQL).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _merging, "lang string, prefix binary, next array<binary>, counts array<long>")


def _count_run(words: list[bytes], start: int, longest: list[int], stripes: Stripes) -> None:
    """Count the phrases that end with each pair from word ``start`` on, up to the ``longest`` of each."""
    for at, most in enumerate(longest, start):
        after = words[at + 1]
        prefix = words[at]
        for size in range(2, most + 1):
            if size > 2:
                prefix = words[at + 2 - size] + b" " + prefix
            stripe = stripes.get(prefix)
            if stripe is None:
                stripe = stripes[prefix] = {}
            stripe[after] = stripe.get(after, 0) + 1


def _sent(held: dict[str, Stripes], hot: dict[tuple[str, bytes], int], blocks: int) -> Iterator[pa.RecordBatch]:
    """The held stripes as rows of blocks, hot ones in slots; ``held`` keeps its empty dicts."""
    for lang, stripes in held.items():
        rows: dict[int, tuple[list, list, list, list]] = {}
        for prefix, counts in stripes.items():
            slots = hot.get((lang, prefix.split(b" ", 1)[0]), 1)
            parts: dict[int, tuple[list, list]] = {}
            if slots == 1:
                parts[0] = list(counts), list(counts.values())
            else:
                for word, n in counts.items():
                    some = parts.setdefault(zlib.crc32(word) % slots, ([], []))
                    some[0].append(word)
                    some[1].append(n)
            for slot, (words, some) in parts.items():
                block = rows.setdefault(zlib.crc32(prefix, slot) % blocks, ([], [], [], []))
                block[0].append(prefix)
                block[1].append(slot)
                block[2].append(b" ".join(words))
                block[3].extend(some)
        stripes.clear()
        while rows:
            some = [rows.popitem() for _ in range(min(256, len(rows)))]
            yield _batch([(lang, block, b"\n".join(prefixes), np.array(slots, "<i4").tobytes(), b"\n".join(words),
                           np.array(counts, "<i8").tobytes()) for block, (prefixes, slots, words, counts) in some])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCK, strict=True)],
                                      schema=_BLOCK)


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole stripes; the parts of a block follow each other."""
    now, merged = None, {}

    def done() -> Iterator[pa.RecordBatch]:
        stripes = [(prefix, list(counts), list(counts.values())) for (prefix, _), counts in merged.items()]
        for start in range(0, len(stripes), 5000):
            prefixes, words, counts = zip(*stripes[start:start + 5000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(prefixes), pa.string()), pa.array(prefixes, pa.binary()),
                 pa.array(words, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))],
                ["lang", "prefix", "next", "counts"])

    for batch in slices(batches, 16):
        for lang, block, prefixes, slots, lines, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (lang, block):
                yield from done()
                now, merged = (lang, block), {}
            numbers = iter(np.frombuffer(raw, "<i8").tolist())
            for prefix, slot, words in zip(prefixes.split(b"\n"), np.frombuffer(slots, "<i4").tolist(),
                                           lines.split(b"\n"), strict=True):
                counts = merged.setdefault((prefix, slot), {})
                for word, n in zip(words.split(b" "), numbers):
                    counts[word] = counts.get(word, 0) + n
    yield from done()


def _merged(stripes: DataFrame, at_least: int) -> DataFrame:
    """(lang, prefix, next, counts, most): the stripes without entries below ``at_least``; staged."""
    kept = stripes.select("lang", "prefix", F.filter(
        F.arrays_zip("next", "counts"), lambda entry: entry["counts"] >= at_least).alias("kept")).filter("size(kept) > 0")
    return stage(kept.select("lang", "prefix", F.col("kept.next").alias("next"), F.col("kept.counts").alias("counts"),
                             F.array_max("kept.counts").alias("most")), "stripes")


def _extensions(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, n): the frequent extensions of all prefixes."""
    found = stripes.filter("most > 0").select("lang", "prefix", F.explode(F.arrays_zip("next", "counts")).alias("e"))
    return found.select("lang", F.concat(F.col("prefix").cast("string"), F.lit(" "), F.col("e.next").cast("string")).alias(
        "phrase"), F.col("e.counts").alias("n"))


def _subsumed(phrases: DataFrame, stripes: DataFrame, covered: int) -> DataFrame:
    """(lang, phrase) contained in a longer candidate with enough of its occurrences.

    Counts can only fall as a phrase grows, so the longer ones by one word decide:
    the largest extension to the right is the maximum of the prefix's stripe, the
    largest to the left that of its entries in the stripes one word longer.
    """
    right = stripes.select("lang", F.col("prefix").cast("string").alias("phrase"), "most").filter("most > 0")
    rest = F.expr("substr(phrase, instr(phrase, ' ') + 1)")
    left = _extensions(stripes).select("lang", rest.alias("phrase"), F.col("n").alias("most"))
    most = right.union(left).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    enough = F.col("most").cast("decimal(19,0)") * 100 >= F.col("n").cast("decimal(19,0)") * covered
    return phrases.join(most, ["lang", "phrase"]).filter((F.col("most") > 0) & enough).select("lang", "phrase")


def _scored(phrases: DataFrame, often: DataFrame, lengths: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate, by its lowest-scoring cut."""
    counts = stage(phrases.union(often).toDF("lang", "part", "n"), "counts")
    heads = checked_broadcast(counts).toDF("lang", "head", "l")
    rests = checked_broadcast(counts).toDF("lang", "rest", "r")
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(
        F.sequence(F.lit(1), F.size(words) - 1)).alias("k")).withColumns({
            "head": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "),
            "rest": F.array_join(F.slice(words, F.col("k") + 1, F.lit(MOST_WORDS)), " ")})
    cuts = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(F.broadcast(lengths), "lang")
    best = cuts.withColumn("score", exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).groupBy(
        "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def exact_score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """``floor(1000 a n / (l r))`` in whole numbers of up to 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, n, l, r)]
    top = (wide[0] * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)") * wide[1].cast("decimal(18,0)")
    return F.call_function("div", top, wide[2] * wide[3].cast("decimal(18,0)"))


def _ranked(scored: DataFrame, at_most: int, first: int) -> DataFrame:
    """The first of each language, in two rounds, so that one language is not one task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    tasks = max(1, -(-at_most // RANKED))
    some = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(tasks)))
    for keys in (["lang", "_part"], ["lang"]):
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
            F.col("rank") <= first)
    return some.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
