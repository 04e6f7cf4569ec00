"""Spelling variants by composing finite-state machines.

The vocabulary is an acceptor, one edit is a transducer, and the variants are the
pairs that ``acceptor o edit o acceptor`` accepts. The composition is enumerated
apart for each initial state, so that no task holds the whole vocabulary:

* One edit leaves the first half of the shorter word or else its second half as it
  was. Words that share a first half start from the same state of the
  acceptor; words that share a second half from the same state of the acceptor
  of reversed words. Either way a pair belongs to one state.
* Each state's words, without the shared half, become a minimal acceptor of
  their own, which is composed with the transducer and itself.
* A state with more than ``STATE_WORDS`` words is split again by halves of what its
  words do not share, until all states are small or one code point is left.

Pairs never leave a task: each state sends a word's number of near words and the
best one, which are combined by word. Roots are found by pointer doubling.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.llm.common import checked_broadcast, slices, text_batches
from stowline.sources.staging import most_rows, stage

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One run in so many loses a code point.
DROPPED = 31
#: Words of one initial state composed in one task; the least useful value is about 10,000.
STATE_WORDS = 20_000
#: Counter entries a task holds before it sends them on.
HELD = 200_000


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES,
             dropped: int = DROPPED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the corpus.

    Words come from :func:`vocabulary`. ``n_near`` counts words at one inserted,
    deleted or replaced code point; ``form`` is the near word of largest count
    (ties: first in code-point order) if that is at least ``times`` the word's
    own; ``root`` is the last form reached from the word, or the word.

    A null text has no words, a null id counts as the empty text in the
    rule that drops code points. Repeated rows count again, texts and runs of any
    length are taken whole, other columns are ignored. No words give no rows.
    """
    if times <= 1:
        raise ValueError("a form must occur more often than its word")
    words = vocabulary(docs, least_length, least_count, dropped, doc_id, text)
    near = near_words(words)
    form = F.when(F.col("best.n") >= F.col("n") * times, F.col("best.word"))
    found = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), F.col("best.n")).alias("form_n")), "variants")
    return found.join(_roots(found, times), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
               dropped: int = DROPPED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, with enough code points and occurrences; staged.

    Where ``dropped`` divides the crc32 of ``<doc_id>:<run>``, the run first loses the
    code point at that number modulo its length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches, 64):
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = zlib.crc32(("" if doc is None else f"{doc}").encode() + b":")
                # Bytes are lower-cased in A-Z alone.
                found = Counter(RUNS.findall(raw.lower().decode()))
                for word, n in found.items():
                    if len(word) >= least_length:
                        h = zlib.crc32(word.encode(), head)
                        if h % dropped == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= HELD:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)

    rows = docs.select(F.col(doc_id).cast("string").alias("doc"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    with text_batches(docs.sparkSession):
        return stage(rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(
            F.col("n") >= least_count), "vocabulary")


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                      ["word", "n"])


def near_words(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """(word, n_near, best) of the words that have any near word; ``best`` is (n, word).

    ``words`` (word, n) are distinct; none may be empty.
    """
    length = F.char_length("word")
    least = words.agg(F.min(length)).first()[0] or 0
    rows = words.select(F.lit("").alias("state"), F.lit(False).alias("closed"), F.explode(F.array(
        length, length - 1)).alias("shorter"), F.col("word").alias("open"), "word", "n").filter(F.col("shorter") >= max(1, least))
    rows = rows.withColumn("state", F.col("shorter").cast("string"))
    small = []
    while True:
        rows = stage(_halves(rows), "states")
        crowded = stage(rows.groupBy(F.xxhash64("state").alias("_state")).agg(F.count("*").alias("_n")).filter(
            F.col("_n") > state_words).select("_state"), "crowded")
        if not most_rows(crowded):
            small.append(rows)
            break
        # States that one code point separates cannot be split.
        rows = rows.withColumn("_state", F.xxhash64("state"))
        hot = checked_broadcast(crowded)
        split = F.col("shorter") > 1
        small += [rows.join(hot, "_state", "left_anti").drop("_state"),
                  rows.filter(~split).join(hot, "_state", "left_semi").drop("_state")]
        rows = rows.filter(split).join(hot, "_state", "left_semi").drop("_state")
    found = None
    for some in small:
        part = _enumerated(some)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min_by("best", F.struct(
        -F.col("best.n"), "best.word")).alias("best"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the two states of its halves: of ``open``, the part of the word its state does not share.

    A state holds words whose open part has ``shorter`` code points, or one more.
    Pairs that share the first half belong there, so a state of a second half is
    ``closed``: a word that only goes on at the end is no partner in it.
    """
    half = F.floor(F.col("shorter") / 2).cast("int")
    rest = F.col("shorter") - half

    def state(side: str, shared: Column) -> Column:
        return F.concat("state", F.lit(side), shared)

    def part(start: Column, size: Column) -> Column:
        return F.substr("open", start, size)

    size = F.char_length("open")
    first = F.struct(state("<", part(F.lit(1), half)).alias("state"), F.col("closed").alias("closed"), rest.alias("shorter"),
                     part(half + 1, size).alias("open"))
    second = F.struct(state(">", part(size - rest + 1, rest)).alias("state"), F.lit(True).alias("closed"),
                      half.alias("shorter"), part(F.lit(1), size - rest).alias("open"))
    return rows.select(F.explode(F.array(first, second)).alias("_h"), "word", "n").select("_h.*", "word", "n")


def _enumerated(rows: DataFrame) -> DataFrame:
    """(word, n_near, best) within each state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for closed, shorter, words in _states(batches):
            done += _near_in_state(words, shorter, closed)
            if len(done) >= 10_000:
                yield _results(done)
                done = []
        if done:
            yield _results(done)

    return rows.select("state", "closed", "shorter", "open", "word", "n").repartition("state").sortWithinPartitions(
        "state").mapInArrow(run, "word string, n_near long, best struct<n:long,word:string>")


def _results(done: list[tuple]) -> pa.RecordBatch:
    words, counts, best_n, best = zip(*done)
    return pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.StructArray.from_arrays(
            [pa.array(best_n, pa.int64()), pa.array(best, pa.string())], ["n", "word"])], ["word", "n_near", "best"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int, dict[str, tuple[str, int]]]]:
    """(closed, shorter, {open: (word, n)}) of each state; its rows follow each other."""
    now, closed, shorter, words = None, False, 0, {}
    for batch in slices(batches, 4096):
        for state, *flags, open_, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state != now:
                if len(words) > 1:
                    yield closed, shorter, words
                now, (closed, shorter), words = state, flags, {}
            words[open_] = word, n
    if len(words) > 1:
        yield closed, shorter, words


def _near_in_state(words: dict[str, tuple[str, int]], shorter: int, closed: bool) -> list[tuple]:
    """(word, near words, n and text of the best) of one state's words.

    Two words of the longer length are compared in another state.
    """
    near: dict[str, tuple[int, int, str]] = {}

    def add(open_: str, other: str) -> None:
        word, n = words[other]
        count, best, text = near.get(open_, (0, -1, ""))
        if n > best or (n == best and word < text):
            best, text = n, word
        near[open_] = count + 1, best, text

    for one, two in Acceptor(words).composed():
        if len(one) > len(two):
            one, two = two, one
        if len(one) > shorter or (closed and two[:-1] == one):
            continue
        add(one, two)
        add(two, one)
    return [(words[open_][0], *found) for open_, found in near.items()]


class Acceptor:
    """The minimal acyclic acceptor of a set of words.

    A state is a number; ``arcs[state]`` leads from a code point to the next one.
    States with the same arcs and the same finality are one.
    """

    def __init__(self, words):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], list[str]] = {}
        self._edits: dict[int, list[tuple[str, str]]] = {}
        # Walks go down one level for each code point.
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 2 * max(map(len, words), default=0)))
        # Words come in order, so a branch is complete when the next word leaves it.
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        letters: list[str] = []
        for word in sorted(words):
            same = 0
            while same < min(len(letters), len(word)) and letters[same] == word[same]:
                same += 1
            self._close(path, letters, same)
            for letter in word[same:]:
                letters.append(letter)
                path.append(({}, False))
            path[-1] = path[-1][0], True
        self._close(path, letters, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, letters: list[str], keep: int) -> None:
        while len(letters) > keep:
            done = self._state(*path.pop())
            path[-1][0][letters.pop()] = done

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = final, tuple(arcs.items())
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return found

    def common(self, one: int, two: int) -> list[str]:
        """The words that both states accept."""
        if one > two:
            one, two = two, one
        found = self._common.get((one, two))
        if found is None:
            a, b = self.arcs[one], self.arcs[two]
            found = [""] if self.final[one] and self.final[two] else []
            for letter in a if one == two else a.keys() & b.keys():
                found += [letter + rest for rest in self.common(a[letter], b[letter])]
            self._common[one, two] = found
        return found

    def _edited(self, state: int) -> list[tuple[str, str]]:
        """The pairs accepted from ``state`` whose first letters are the edit, each pair one way round.

        The transducer replaces the next letter, or inserts one; deletion is
        insertion the other way round.
        """
        found = self._edits.get(state)
        if found is None:
            arcs = list(self.arcs[state].items())
            found = []
            for at, (letter, after) in enumerate(arcs):
                for other, elsewhere in arcs[at + 1:]:
                    found += [(letter + rest, other + rest) for rest in self.common(after, elsewhere)]
                for rest in self.common(state, after):
                    # An insertion into a row of equal letters counts at its end.
                    if not rest.startswith(letter):
                        found.append((rest, letter + rest))
            self._edits[state] = found
        return found

    def composed(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words that one edit turns into each other, each once."""
        waiting = [(self.start, "")]
        while waiting:
            state, path = waiting.pop()
            for one, two in self._edited(state):
                yield path + one, path + two
            waiting += [(after, path + letter) for letter, after in self.arcs[state].items()]


def _roots(found: DataFrame, times: int) -> DataFrame:
    """(word, root) of the words that have a form, by doubling the length of the step.

    Each form occurs ``times`` as often as its word, which bounds the rounds.
    """
    steps = stage(found.filter("form is not null").select("word", F.col("form").alias("root")), "steps")
    most = found.agg(F.max("n")).first()[0] or 1
    chain = math.log(most) / math.log(times) + 1
    for _ in range(math.ceil(math.log2(max(2, chain)))):
        if not most_rows(steps):
            break
        onward = checked_broadcast(steps).select(F.col("word").alias("root"), F.col("root").alias("_on"))
        steps = stage(steps.join(onward, "root", "left").select("word", F.coalesce("_on", "root").alias("root")), "steps")
    return steps
