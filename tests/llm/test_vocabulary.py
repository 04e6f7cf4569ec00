"""Collocations, spelling variants and packing against brute-force versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stowline.llm import collocations, packing, spelling, token_files

WORD_IDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, n long, word string, phrase string, part int, ids string, state string"


@pytest.fixture
def docs(spark):
    def make(rows):
        """(doc_id, text, lang) rows with further columns whose names operators use themselves."""
        return spark.createDataFrame([(*r, 1, "x", "x", 1, "x", "x") for r in rows], DOCS)
    return make


ODD = [(None, None, None), (1, "", "en"), (2, " \t\n.,", "en"), (3, "word " * 30_000, "en"), (3, "word " * 30_000, "en")]


# collocations

def phrases_of(rows, at_least, first, covered=100):
    counts = {}
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "")):
            piece = re.sub("[A-Z]", lambda m: m[0].lower(), piece)
            words = [w for w in re.split("[ \t]", piece) if w]
            own = counts.setdefault("und" if lang is None else lang, Counter())
            for k in range(1, 6):
                own.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= at_least}

        def inside(p, q):
            return any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))

        ranked = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and inside(p, q) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(seed, rows=60):
    draw = random.Random(seed)
    words = ["the", "The", "of", "é", "über", "a", "b", "x ", "日本", "\x1c", "end\x85"]
    passage = "one two three four five six seven"
    out = []
    for i in range(rows):
        text = "".join(draw.choice(words) + draw.choice([" ", "  ", "\t", ". ", "\n", " ", " "]) for _ in range(draw.randint(0, 80)))
        out.append((i, text + (passage if i % 3 else ""), draw.choice(["en", "en", "de", None, "und", ""])))
    return out


@pytest.mark.parametrize("setting", ["plain", "held", "hot", "bounded"])
def test_collocations(spark, docs, monkeypatch, setting):
    if setting == "held":
        monkeypatch.setattr(collocations, "HELD", 10)
        monkeypatch.setattr(collocations, "LOOK", 3)
        monkeypatch.setattr(collocations, "PAIRS", 20)
    if setting == "hot":
        monkeypatch.setattr(collocations, "HOT", 30)
        monkeypatch.setattr(collocations, "RANKED", 7)
    if setting == "bounded":
        spark.conf.set("spark.stowline.bloomBlocks", "1")
    rows = corpus(1) + ODD
    for covered in (100, 60):
        found = collocations.collocations(docs(rows), 5, 25, covered)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == phrases_of(rows, 5, 25, covered)
    spark.conf.unset("spark.stowline.bloomBlocks")


def test_collocations_of_nothing(docs):
    assert collocations.collocations(docs([])).collect() == []
    assert collocations.collocations(docs(ODD[:3])).collect() == []


def test_scores_beyond_64_bits(spark):
    rows = [(10 ** 13, 10 ** 14, 10 ** 13, 10 ** 13), (100, 10 ** 17, 100, 100), (7, 13, 3, 9),
            (2 * 10 ** 15 + 1, 9 * 10 ** 17, 10 ** 17 + 3, 10 ** 17 + 9), (10 ** 15, 10 ** 17, 10 ** 15 + 1, 10 ** 15 + 1)]
    table = spark.createDataFrame(rows, "a long, n long, l long, r long")
    score = collocations.exact_score(*map(F.col, "anlr"))
    assert [r[0] for r in table.select(score).collect()] == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_stripes_travel_in_blocks():
    """A task sends a row for each block, however many prefixes it has; merged, the counts are whole."""
    def held():
        return {"en": {b"p%d" % i: {b"a": i + 1, b"b%d" % i: 2} for i in range(5000)}, "de": {b"x y": {b"z": 1}}}

    sent = [batch for _ in range(3) for batch in collocations._sent(held(), {("en", b"p7"): 3}, 16)]
    assert sum(batch.num_rows for batch in sent) == 3 * (16 + 1)
    parts = pa.Table.from_batches(sent).sort_by([("lang", "ascending"), ("block", "ascending")])
    found: dict = {}
    for batch in collocations._merging(iter(parts.to_batches())):
        for lang, prefix, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault((lang, prefix), []).extend(zip(words, counts, strict=True))
    assert {k: sorted(v) for k, v in found.items()} == {
        (lang, prefix): sorted((w, 3 * n) for w, n in counts.items())
        for lang, stripes in held().items() for prefix, counts in stripes.items()}


def test_stripes_hold_all_extensions(docs, monkeypatch):
    """The merged stripes count every frequent extension; nothing that is rare by its triples is in a stripe."""
    seen = {}
    kept = collocations._merged
    monkeypatch.setattr(collocations, "_merged", lambda stripes, at_least: seen.update(
        partial=stripes, merged=kept(stripes, at_least)) or seen["merged"])
    rows = corpus(2)
    collocations.collocations(docs(rows), 5).collect()
    true = phrases_of(rows, 5, 10 ** 9, 10 ** 9)  # nothing is dropped
    found = {(r.lang, r.prefix.decode() + " " + w.decode()): n for r in seen["merged"].collect()
             for w, n in zip(r.next, r.counts)}
    assert found == {(lang, phrase): a for lang, _, phrase, a, *_ in true}
    partial = {(r.lang, r.prefix.decode()) for r in seen["partial"].collect()}
    assert {p for p in partial if p[1].count(" ") == 1} <= set(found)


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    monkeypatch.setattr(collocations, "STRETCH", 64)
    monkeypatch.setattr(collocations, "HASHED", 16)
    collocations._powers.cache_clear()
    draw = random.Random(6)
    words = [bytes(draw.choice(b"abcxyz\xc3\xa9") for _ in range(draw.choice([1, 2, 5, 9, 40, 200]))) for _ in range(60)]
    line = words + draw.sample(words, 60)
    ends = np.cumsum([len(w) + 1 for w in line])
    raw = np.frombuffer(b" ".join(line) + b" ", np.uint8)
    found = collocations.word_hashes(raw, ends - [len(w) + 1 for w in line], ends - 1)
    by_word = {}
    for w, h in zip(line, found.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    short = {w for w in words if len(w) <= 16}
    assert len({by_word[w] for w in short}) == len(short)
    collocations._powers.cache_clear()


# spelling

def words_of(rows, least_length=7, least_count=2):
    counts = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_of(words, times=10):
    out, form = [], {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= times * words[w]:
            form[w] = best
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out)


def misspelt(seed):
    draw = random.Random(seed)
    letters = "abcÀéÿß×÷"
    seeds = ["".join(draw.choice(letters) for _ in range(draw.randint(6, 12))) for _ in range(12)] + ["aaaaaaaa", "aaaaaaab"]
    out = []
    for i in range(80):
        text = []
        for _ in range(draw.randint(0, 120)):
            w = draw.choice(seeds)
            for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
                at = draw.randint(0, len(w))
                w = draw.choice([w[:at] + draw.choice(letters) + w[at:], w[:at] + w[at + 1:],
                                 w[:at] + draw.choice(letters) + w[at + 1:]])
            text.append(w.upper() if draw.random() < .1 else w)
        out.append((i if i % 9 else None, draw.choice([" ", ".", "1"]).join(text), "en"))
    return out


@pytest.mark.parametrize("state_words", [20_000, 60, 1])
def test_variants(docs, monkeypatch, state_words):
    monkeypatch.setattr(spelling, "STATE_WORDS", state_words)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (state_words,))
    rows = misspelt(3) + ODD + [(7, "long" * 2000 + " " + "long" * 2000 + "x " + "a" * 1500 + " " + "a" * 1501, "en")] * 2
    found = spelling.variants(docs(rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    true = variants_of(words_of(rows))
    assert sum(r[1] is not None for r in true) > 5 and sum(r[4] for r in true) > 200
    assert sorted(map(tuple, found.collect())) == true


def test_chain_of_forms(spark, docs):
    rows, word = [], "abcdefgh"
    counts = [2, 20, 200, 2000, 20_000]
    for k, n in enumerate(counts):
        rows.append((None, " ".join([word[:k] + "z" * k + word[k:]] * n), "en"))
    found = {r.word: r for r in spelling.variants(docs(rows)).collect()}
    true = {r[0]: r for r in variants_of(words_of(rows))}
    assert {w: tuple(r) for w, r in found.items()} == true


def test_variants_of_nothing(docs):
    assert spelling.variants(docs([])).collect() == []
    assert spelling.variants(docs(ODD[:4])).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_acceptor(seed):
    draw = random.Random(seed)
    words = {"".join(draw.choice("ab" if seed % 2 else "abcd") for _ in range(draw.randint(0, 6))) for _ in range(60)}
    machine = spelling.Acceptor(words)
    assert set(machine.common(machine.start, machine.start)) == words
    pairs = [tuple(sorted(p)) for p in machine.composed()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    # Minimal: no two states accept the same words.
    right = [tuple(sorted(machine.common(s, s))) for s in range(len(machine.arcs))]
    assert len(right) == len(set(right))


# packing

TEXTS = [(1, "The cat's 12 hats, naïve Élan", "en"), (2, "日本語 ŉ ǅ x\x1cy á \x85 q r", "en"),
         (3, "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "en"), (4, "hello world " * 2000, "en"), (4, "hello world " * 2000, "en"),
         (5, "a\tb\rc\x0bd\x0ce f", "en"), (6, "I'll we've I'M 'tis x'll'll", "en")]


@pytest.mark.parametrize("window", [2048, 7])
def test_packing(spark, docs, window):
    rows = ODD + TEXTS + corpus(4, 30)
    pieces = packing.pack(docs(rows).repartition(5), WORD_IDS, 1, window)
    found = pieces.collect()
    library = Tokenizer.from_file(WORD_IDS)
    true = Counter()
    for doc, text, _ in rows:
        true[doc, *library.encode(text or "", add_special_tokens=False).ids, 1] += 1

    # Pieces of one sequence are gapless from 0, and all but the last sequence are full.
    place = {}
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        assert (r.sequence_id, r.offset) not in place
        place[r.sequence_id, r.offset] = r
    flat, doc, seen = [], None, Counter()
    total = sum(r.length for r in found)
    cut = {}
    for (sequence, offset), r in sorted(place.items()):
        assert sequence * window + offset == len(flat)
        ids = np.frombuffer(r.ids, "<u4").tolist()
        flat += ids
        cut.setdefault(sequence, []).append((offset, r.length, r.doc_id, r.start))
        if r.start == 0:
            doc = []
        assert len(doc) == r.start
        doc += ids
        if len(doc) == r.doc_tokens:
            seen[r.doc_id, *doc] += 1
    assert seen == true
    assert total == sum(len(k[1:]) * n for k, n in true.items())

    # Whole sequences.
    made = {r.sequence_id: r for r in packing.sequences(pieces, 9, window).collect()}
    assert sorted(made) == list(range(-(-total // window)))
    for s, r in made.items():
        ids = flat[s * window:(s + 1) * window]
        full = window if len(ids) & (len(ids) - 1) else len(ids)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids + [9] * (full - len(ids))
        assert r.n_tokens == len(ids)
        assert [(p.offset, p.length, p.doc_id, p.start) for p in r.pieces] == cut[s]


def test_packing_nothing(docs):
    pieces = packing.pack(docs([]), WORD_IDS, 1)
    assert pieces.collect() == [] and packing.sequences(pieces, 0).collect() == []


def test_packing_shuffles_nothing(docs):
    plan = packing.pack(docs(TEXTS), WORD_IDS, 1)._jdf.queryExecution().executedPlan().toString()
    # Only the part sums (one row per part) are exchanged.
    assert "ids" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_encoder_in_generations(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 5)
    own, library = token_files.Encoder(WORD_IDS), Tokenizer.from_file(WORD_IDS)
    texts = [t for _, t, _ in TEXTS + corpus(5, 20)]
    for start in range(0, len(texts), 3):
        for text, ids in zip(texts[start:start + 3], own.encode(texts[start:start + 3]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]
