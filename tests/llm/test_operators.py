"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and clashes."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from pyspark.sql import functions as F

from stowline.llm import (labelled, mixing, near_vectors, neighbours, page_text, pieces, quality, simhash, token_files,
                          toxicity, urls)
from stowline.llm.common import BATCH_BYTES, Memory, bound_batches
from stowline.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, host string, fp string"
LONG = "word " * 60_000


@pytest.fixture
def docs(spark):
    def make(rows):
        """(doc_id, text[, source]) rows with further columns whose names operators use themselves."""
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", "x", "x")
                                      for r in rows], DOCS)
    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b c"), (5, "a b c"), (None, "a b c"), (6, "é ▁x 日本\x00")]


# 1

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"), ("block", "com/de/"), ("allow", "com/de/"), ("block", "a.com"), ("allow", "a.com/x/y")]
URLS = ["http://Example.ORG/es/1", "https://m.example.org/en/12?x#y", "http://x.org", "http://org/", None, "", "no host",
        "http://a.com/x/yz", "http://b.a.com?q", "http://xa.com/", "http://x.com/de/", "http://x.com/de", "http:///p"]


def judged(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(r.count("."), len(r), v == "block", r, v) for v, r in RULES for h, s, p in [r.partition("/")]
            if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


@pytest.mark.parametrize("most", [urls.TRIE_RULES, 0])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "TRIE_RULES", most)  # 0: by joins
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)],
                                  "page_id long, url string, rule string, host string")
    out = urls.filter_urls(pages, urls.rules_table(spark, RULES), keep=("page_id",)).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in out] == [judged(u) for u in URLS * 2]
    assert urls.filter_urls(pages.limit(0), urls.rules_table(spark, RULES)).count() == 0


# 2

def test_pieces(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()}
    rows = [*enumerate(sorted(texts)), *ODD, (7, "   x  y\n z "), (8, "\r\n{\r\n"), (9, "梦" * 90 + " 龘")]
    out = pieces.encode_decode(docs(rows), public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "text"))
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == library.encode(r.text or "")
        assert r.decoded == library.decode(r.ids)
    draw = random.Random(1)
    ids = [[draw.randrange(32000) if draw.random() < .6 else draw.randrange(259) for _ in range(draw.randrange(12))]
           for _ in range(500)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(ids)] + [(-1, None)], "n int, ids array<int>")
    for r in pieces.decode_ids(frame, public_tokenizers.path("piece_bpe_32k.model"), keep=("n",)).collect():
        assert r.decoded == (library.decode(ids[r.n]) if r.n >= 0 else "")


# 3

@pytest.mark.parametrize("unit, block", [("byte", 1000), ("bit", 64)])
def test_token_files(spark, docs, tmp_path, unit, block):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [*ODD, (7, "<|endoftext|>It's I'LL ½ \x85 ΣΑΣ é 'D x'd"), (-3, "x " * 500), (9, "ÀÖß ×÷ ÿ a\tb")]
    token_files.write_ids(token_files.tokenize(docs(rows), path, 2), str(tmp_path / "f"), unit, block)
    out = token_files.read_ids(spark, str(tmp_path / "f")).orderBy("start").collect()
    own = sorted(((-math.inf if d is None else d, library.encode(t or "", add_special_tokens=False).ids + [2])
                  for d, t in rows), key=lambda x: x[0])
    assert [(-math.inf if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in out] == own
    assert [r.start for r in out] == np.cumsum([0, *(len(i) for _, i in own)])[:-1].tolist()
    token_files.write_ids(token_files.tokenize(docs([]), path, 2), str(tmp_path / "none"))
    assert token_files.read_ids(spark, str(tmp_path / "none")).count() == 0


# 4 and 6

def vectors(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((300, 8)).astype(np.float32)
    group = base[0] + 0.05 * draw.standard_normal((60, 8)).astype(np.float32)
    rows = [(i, v.tolist(), i, "x", 1) for i, v in enumerate([*base, *group, *base[:20], 2 * base[5], *[base[7]] * 30])]
    bad = [None, [], [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [None] + [1.0] * 7]
    rows += [(1000 + i, v, None, "x", 1) for i, v in enumerate(bad)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vec string, n int"), rows


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_near_vectors(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(near_vectors, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(near_vectors, "SHARD", 60)
    frame, rows = vectors(spark)
    good = [(r[0], np.array(r[1], float)) for r in rows if r[0] < 1000]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.95
    label = np.arange(len(good))
    for row in near:
        joined = np.unique(label[row])
        label[np.isin(label, joined)] = joined[0]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(frame).collect()}
    assert len(out) == len(rows)
    for i in range(len(good)):
        assert out[i] == (near[i].sum() - 1, label[i], label[i] == i)
    assert all(out[r[0]] == (0, r[0], True) for r in rows if r[0] >= 1000)
    assert near_vectors.near_vectors(frame.limit(0)).count() == 0
    assert near_vectors.audit_recall(frame, near_vectors.near_vectors(frame)) == 1.0


def test_near_vectors_in_many_dimensions(spark):
    """5,000 vectors of 64 dimensions, with groups of near copies of up to 300, in overlapping shards."""
    draw = np.random.default_rng(9)
    points = draw.normal(size=(5000, 64))
    at = 0
    for size, noise in ((300, 0.12), (100, 0.2), (40, 0.3), (20, 0.05), *[(2, 0.28)] * 100):
        points[at:at + size] = points[at] + noise * draw.normal(size=(size, 64))
        at += size
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    frame = spark.createDataFrame(list(enumerate(points.tolist())), "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in near_vectors.near_vectors(frame).collect()}
    links = np.array([found[i] for i in range(5000)])
    assert (links <= true).all()
    assert links.sum() % 2 == 0 and links.sum() >= 0.999 * true.sum() > 50_000


def test_unusable_vectors_of_a_repeated_id_stay(spark):
    rows = [(1, [1.0, 0.0]), (1, None), (1, [0.0, 0.0]), (1, [math.nan, 1.0]), (1, [None, 1.0]), (2, [1.0, 0.01]),
            (None, [1.0, 0.0]), (3, [])]
    out = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(
        [(1, 1, 1, True), (2, 1, 1, False), *[(1, 0, 1, True)] * 4, (None, 0, None, True), (3, 0, 3, True)], key=repr)


@pytest.mark.parametrize("split", [20_000, 10])
def test_neighbours(spark, monkeypatch, split):
    monkeypatch.setattr(neighbours, "SPLIT", split)
    monkeypatch.setattr(neighbours, "BUCKET", 16)
    frame, rows = vectors(spark)
    good = [(r[0], np.array(r[1], float)) for r in rows if r[0] < 1000]
    asked = frame.filter("vec_id % 10 = 0")
    found = defaultdict(list)
    for r in neighbours.near_neighbours(frame, asked.union(asked)).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hits = 0
    assert set(found) == {i for i, _ in good if i % 10 == 0}
    for q, got in found.items():
        true = sorted((np.sqrt(((v - good[q][1]) ** 2).sum()), i) for i, v in good if i != q)[:10]
        assert len(got) == 10 and got == sorted(got, key=lambda x: (x[1], x[0]))
        assert all(abs(s - np.linalg.norm(good[i][1] - good[q][1])) < 1e-12 for i, s in got)
        hits += len({i for _, i in true} & {i for i, _ in got})
    assert hits >= 0.9 * 10 * len(found)
    few = frame.filter("vec_id in (0, 10, 20, 1000)")
    assert neighbours.near_neighbours(few, few).count() == 6
    assert neighbours.near_neighbours(frame.limit(0), frame.limit(0)).count() == 0


# 5

def test_page_texts(spark):
    article = "<article><h1>T &amp; U</h1><p>One\n two<p>three<div class='comments'>c</div></article>"
    page = "<html><body><nav>menu</nav><script>x('<p>')</script>{}<footer>f</footer></body>"
    plain = "<div>site line</div><div>{}</div><div>last</div>"
    rows = [(1, "http://a.com/1", page.format(article)), (2, "http://a.com/2", page.format(article)),
            (3, "http://b.com/1", plain.format("own 1")), (4, "http://b.com/2", plain.format("own 2")),
            (5, "http://c.com/", plain.format("alone")), (6, None, plain.format("no url")), (7, "http://d.com/", None),
            (8, "http://d.com/x", ""), (9, "http://e.com/", "<p>&am" + "z " * 50_000), (9, "http://f.com/", "<<>&#0;")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows],
                                  "page_id long, url string, html string, path string, lines string")
    out = {r.url: (r.text, r.n_chars) for r in page_text.page_texts(frame).collect()}
    assert out["http://a.com/1"][0] == out["http://a.com/2"][0] == "T & U One two three"
    assert out["http://b.com/1"] == ("own 1", 5) and out["http://b.com/2"] == ("own 2", 5)
    assert out["http://c.com/"][0] == "site line alone last" and out[None][0] == "site line no url last"
    assert out["http://d.com/"] == out["http://d.com/x"] == ("", 0)
    assert out["http://e.com/"][1] == len("&am" + "z " * 50_000) - 1
    assert page_text.page_texts(frame.limit(0)).count() == 0


@pytest.mark.parametrize("html, text", [
    ("<body><div class='site has-sidebar'><main><article><p>a</article></main></div>", "a"),
    ("<div class='no-sidebar'><article>a</article><div class='Share x'>s</div></div>", "a"),
    ("<div id='social-wall' class='no-menu'>a</div><div class='menu'>m</div>", "a"),
    ("<div class='sidebar'>s<article>a<div class='comments'>c<article>d</article></div></article>s</div>", "a"),
    ("<div class='widget'><div role='main'>a</div></div>", "a"),
    ("<article>a</article><div class='sidebar'><article>teaser</article></div>", "a"),
    ("<nav><article>a</article></nav><div role='banner'><main>b</main></div>", ""),
    ("<head><title>t</title><body><p>a", "a"),
    ("<html><head><title>t</title><meta name=x><p>a<div>b</div>", "a b"),
    ("<head><title>t</title><script>s</script> a <b>b</b>", "a b"),
    ("<head><noscript><img><p>n</p></noscript><title>t</title></head><body>a</body>", "a"),
    ("<head><noscript><p>n<body>a</body>", "a"),
])
def test_layout_names_and_open_heads_leave_the_text(html, text):
    lines = page_text.lines_of(html)
    if any(region == page_text.CONTENT for _, region in lines):
        lines = [x for x in lines if x[1] == page_text.CONTENT]
    assert " ".join(line for line, region in lines if region != page_text.SITE) == text


def test_copies_of_a_page_are_not_its_neighbours(spark):
    plain = "<div>site line</div><div>{}</div><div>last</div>"
    rows = [(1, "http://a.com/1", plain.format("own 1"))] * 3 + [(2, "http://a.com/2", plain.format("own 2"))] * 2
    rows += [(3, "http://b.com/x?a=1", plain.format("twin")), (4, "http://b.com/x?a=2", plain.format("twin")),
             (5, "http://b.com/x?a=2#f", plain.format("twin")), (6, "http://b.com/y", plain.format("other"))]
    rows += [(7, "http://c.com/", plain.format("alone"))] * 2 + [(None, None, plain.format("no url"))] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = sorted(((r.page_id, r.text) for r in page_text.page_texts(frame).collect()), key=repr)
    assert out == sorted([(1, "own 1")] * 3 + [(2, "own 2")] * 2 + [(3, "twin"), (4, "twin"), (5, "twin"), (6, "other")]
                         + [(7, "site line alone last")] * 2 + [(None, "site line no url last")] * 2, key=repr)


@pytest.mark.parametrize("broadcast, block", [(None, 256), (0, 2)])
def test_every_page_is_differenced_and_markup_corrects_it(spark, limits, monkeypatch, broadcast, block):
    limits(broadcast=broadcast)
    monkeypatch.setattr(page_text, "BLOCK", block)
    page = "<nav>menu {}</nav><div>site line</div><article><p>same<p>{}</article><div>beside {}</div><footer>f</footer>"
    rows = [(i, f"http://a.com/{i}", page.format(i, f"own {i}", i)) for i in range(9)]
    rows += [(9, "http://a.com/8?x", page.format("other", "own 8", 8))]  # another menu, else a copy
    rows += [(10, "http://b.com/1", "<nav>Home</nav><p>x"), (11, "http://b.com/2", "<div>Home</div><p>y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: (r.text, r.n_shared) for r in page_text.page_texts(frame).collect()}
    # The site's line beside the article goes, what only this page has beside it stays, and the shared line inside is spared.
    assert [out[i] for i in range(9)] == [(f"same own {i} beside {i}", 2) for i in range(9)] and out[9] == out[8]
    assert out[10] == ("x", 0) and out[11] == ("y", 1)


def test_shared_lines_are_a_longest_common_subsequence():
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found, rest = page_text.shared_lines(a, b), iter(b)
        assert len(found) == best[-1][-1] and found == sorted(set(found)) and all(a[i] in rest for i in found)


@pytest.mark.parametrize("matches, frequent", [(0.01, 256), (0.01, 1), (0.3, 2)])
def test_halved_lines_are_a_longest_common_subsequence(monkeypatch, matches, frequent):
    monkeypatch.setattr(page_text, "MATCHES", matches)
    monkeypatch.setattr(page_text, "FREQUENT", frequent)
    draw = random.Random(3)
    for _ in range(300):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(40))] for _ in range(2))
        found, rest = page_text.shared_lines(a, b), iter(b)
        assert len(found) == len(page_text._rising_partners(a, b))
        assert found == sorted(set(found)) and all(a[i] in rest for i in found)


def test_long_pages_of_repeated_lines_are_aligned_in_little_memory():
    draw = random.Random(4)
    for lines in (1, 2, 600):
        a, b = ([draw.randrange(lines) for _ in range(n)] for n in (3_000, 2_900))
        tracemalloc.start()
        found = page_text.shared_lines([-1, *a, -2], [-3, *b, -4])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 4_000_000  # one tuple for each match: hundreds of MB for few lines
        assert len(found) == 2_900 if lines == 1 else 0 < len(found) < 2_900


# 7

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    rows = [*ODD[:3], *ODD[4:], *((r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())]
    out = simhash.near_texts(docs(rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps):
            if (a ^ b).bit_count() <= 2 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None)
             for c in set(label)}
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in out), key=key) == sorted(
        ((rows[i][0], fps[i], least[label[i]]) for i in range(len(rows))), key=key)
    kept = simhash.keep_firsts(docs(rows)).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted({v for v in least.values() if v is not None})
    assert simhash.near_texts(docs([])).count() == 0 and simhash.keep_firsts(docs([])).count() == 0


def test_keep_firsts_judges_rows_by_their_own_texts(spark, docs):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")

    def kept(rows):
        return sorted(((r.doc_id, r.text) for r in simhash.keep_firsts(docs(rows)).collect()), key=repr)

    # A null id beside a copy with an id takes no other row without an id along.
    assert kept([(1, x), (None, x), (None, y), (None, z), (None, z)]) == [(1, x), (None, y), (None, z)]
    # A repeated id goes only where its text is a copy.
    assert kept([(3, x), (7, x), (7, y), (9, y)]) == [(3, x), (7, y)]
    assert kept([(7, x), (7, y), (7, x)]) == [(7, x), (7, y)]


def test_null_ids_keep_one_row_of_near_texts(spark, docs):
    words = [f"w{i}" for i in range(400)]
    texts = {plain_fingerprint(" ".join(words[:n])): " ".join(words[:n]) for n in range(200, 401)}
    near = next((texts[a], texts[b]) for a in texts for b in texts if 0 < (a ^ b).bit_count() <= 2)
    out = simhash.keep_firsts(docs([(None, near[0]), (None, near[1]), (None, "p q r s t")])).collect()
    assert sorted(r.text for r in out) == sorted([min(near), "p q r s t"])


def test_near_fingerprints(spark):
    draw = random.Random(4)
    base = [draw.getrandbits(64) for _ in range(40)]
    fps = {b for x in base for b in (x, x ^ 1 << draw.randrange(64), x ^ 3 << draw.randrange(60), x ^ 7 << 9)}
    frame = spark.createDataFrame([(f - 2 ** 64 if f >> 63 else f,) for f in fps], "fp long")
    for bits in (1, 2, 3):
        found = {frozenset((r.a % 2 ** 64, r.b % 2 ** 64)) for r in simhash.near_fingerprints(frame, bits).collect()}
        assert found == {frozenset((a, b)) for a in fps for b in fps if 0 < (a ^ b).bit_count() <= bits}


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == label


# 8

def test_mixing(spark, docs):
    draw = random.Random(6)
    rows = [(i, "w " * draw.randrange(1, 60), draw.choice(["a", "b", "c", "d"])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "x y", None), (1003, " ", "empty"), (None, "q r", "b"), (1, "w w", "a")]
    out = mixing.mix(docs(rows)).collect()
    again = mixing.mix(docs(rows[::-1]).repartition(3)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(rows)
    assert all(r.taken == r.copies * r.size and r.copies in (0, 1, 2) for r in out)
    taken, goal = defaultdict(int), {}
    for r in out:
        taken[r.target] += r.taken
        goal[r.target] = r.source_size
    total = sum(r.size for r in out)
    assert math.isclose(sum(goal), 1.5 * total) and all(t <= 2 * s for t, s in goal.items())
    assert all(abs(taken[t] - t) <= 120 for t in goal) and sum(taken.values()) <= 1.5 * total
    assert mixing.mix(docs([])).count() == 0


def test_running_sums(spark):
    draw = random.Random(8)
    rows = [(draw.randrange(3), i, draw.randrange(9)) for i in range(200)]
    out = mixing.running_sums(spark.createDataFrame(rows, "g long, i long, v long").repartition(4), ["i"], {"s": "v"}, "g")
    for r in out.collect():
        assert r.s == sum(v for g, i, v in rows if g == r.g and i <= r.i)


# 9 and 10

def test_classifiers_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = {r.doc_id: r for r in labels.collect()}
    toxic = toxicity.score_documents(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in toxic) and len(toxic) == 1000
    clean = [r.predicted for r in toxic if r.held_out and r.doc_id in known and not known[r.doc_id].toxic]
    assert sum(clean) <= 0.1 * len(clean)
    good = quality.judge(docs, labels).collect()
    held = [r for r in good if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id].quality for r in held) >= 0.9 * len(held)


def test_classifiers_on_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (None, 1, 1), (5, None, None)],
                                   "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        scored = toxicity.score_documents(docs(ODD), known).collect()
        assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
        judged_ = quality.judge(docs(ODD), known).collect()
        assert len(judged_) == len(ODD) and all(0 <= r.score <= 1 for r in judged_)
        assert toxicity.score_documents(docs([]), known).count() == quality.judge(docs([]), known).count() == 0


def test_sites_shrink_towards_their_host_and_the_corpus(spark):
    rows = [("h1", "p", 3.0)] * 200 + [("h1", "q", -3.0)] + [("h2", "p", -3.0)] * 200 + [(None, None, 3.0)]
    sites = {(r.host, r.path): r for r in quality.site_posteriors(
        spark.createDataFrame(rows, "host string, path string, log_odds double")).collect()}
    assert sites["h1", "p"].path_share > 0.9 and sites["h2", "p"].path_share < 0.1
    assert 0.3 < sites["h1", "q"].path_share < sites["h1", "q"].host_share  # one poor page of a good host
    assert 0.05 < sites[None, None].host_share < 0.95


# All

def test_sql_and_pipeline(spark):
    from stowline.llm.queries import ORACLE, QUERIES
    duck = duckdb.connect()
    for name in ("documents", "pages"):
        duck.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in ORACLE.items():
        own = QUERIES[name](spark, SF)
        wanted = duck.execute(f"select {', '.join(own.columns)} from ({sql})").fetchall()
        assert sorted(map(repr, map(tuple, own.collect()))) == sorted(map(repr, wanted))
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for at, (_, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, docs, SF)
        if at < 4:
            assert out.columns == docs.columns
            docs = out
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert QUERIES["pipeline"](spark, SF).count() == out.count() > 0


def test_mixed_rows_of_one_id_have_their_own_copies(spark, docs):
    import corpus_pipeline
    draw = random.Random(9)
    rows = [(None if i % 3 else 7, f"t{i} " + "w " * draw.randrange(1, 40), draw.choice("abcd")) for i in range(150)]
    rows += [(None, "same text", "a")] * 5
    mixed = mixing.mix(docs(rows)).collect()
    assert len({r.copies for r in mixed if r.doc_id is None}) > 1
    outs = [Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, frame, SF).collect())
            for frame in (docs(rows), docs(rows[::-1]).repartition(3))]
    assert outs[0] == outs[1] and all(n <= 2 * rows.count(row) for row, n in outs[0].items())
    sizes = Counter((r.doc_id, r.size, r.source_size) for r in mixed for _ in range(r.copies))
    of_source = Counter()
    for _, text, source in rows:
        of_source[source] += len(text.split())
    own = Counter()
    for (doc_id, text, source), n in outs[0].items():
        own[doc_id, len(text.split()), of_source[source]] += n
    assert own == sizes  # the mix's own decision, row by row, so within its budget


def test_memory_keeps_frequent_words_and_bounds_the_rest():
    asked = []
    memory = Memory(lambda word: asked.append(word) or len(word), 3)
    words = ["of", "a", "of", "bb", "ccc", "of", "dddd", "of", "eeeee", "of", "a"]
    assert [memory[w] for w in words] == [len(w) for w in words]
    assert asked.count("of") == 1 and len(memory) <= 3


def test_text_batches_are_only_ever_made_smaller(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, bound in (("64m", BATCH_BYTES), ("1g", BATCH_BYTES), ("1m", 1 << 20), ("2097152b", 2 << 20)):
            spark.conf.set(name, given)
            bound_batches(spark)
            left = spark.conf.get(name)
            assert left in (given, str(bound)) and (left == given) == (bound < BATCH_BYTES)
    finally:
        spark.conf.set(name, before)


# Classifiers against plain versions

def test_site_shares_leave_the_document_out(spark):
    draw = random.Random(8)
    rows = [(draw.choice(["h1", "h1", "h2", None]), draw.choice("pq"), draw.gauss(0, 3)) for _ in range(60)] + [("h3", "p", 4.0)]
    evidence = spark.createDataFrame(rows, "host string, path string, log_odds double")
    sites = {(r.host, r.path): r for r in quality.site_posteriors(evidence).collect()}
    host, path = quality.other_shares(F.col("log_odds"))
    table = spark.createDataFrame([(*row, *(sites[row[:2]][c] for c in ("n", "s", "hn", "hs", "share", "host_worth", "path_worth")))
                                   for row in rows], "host string, path string, log_odds double, n long, s double, hn long, "
                                  "hs double, share double, host_worth double, path_worth double")
    good = [1 / (1 + math.exp(-x)) for _, _, x in rows]
    total = sum(good) / len(good)
    for i, r in enumerate(table.select("*", host.alias("host_share"), path.alias("path_share")).collect()):
        others = [(h, p, g) for j, ((h, p, _), g) in enumerate(zip(rows, good)) if j != i]
        at_host = [g for h, _, g in others if h == r.host]
        at_path = [g for h, p, g in others if (h, p) == (r.host, r.path)]
        by_host = (sum(at_host) + r.host_worth * total) / (len(at_host) + r.host_worth)
        by_path = (sum(at_path) + r.path_worth * by_host) / (len(at_path) + r.path_worth)
        assert (r.host_share, r.path_share) == pytest.approx((by_host, by_path))
    assert sites["h3", "p"].path_share > total  # one document speaks for its site, but not for itself


@pytest.mark.parametrize("bias", [-3.0, 3.0])
def test_the_risk_and_its_gradient(bias):
    draw = np.random.default_rng(5)
    width, prior = 12, 0.3
    positive = [draw.integers(0, 6, draw.integers(0, 9)) for _ in range(20)]
    unlabelled = [draw.integers(0, width, draw.integers(0, 9)) for _ in range(50)]
    weights = np.append(draw.normal(size=width), bias)
    sparse = [toxicity.Sparse(x, None, width) for x in (positive, unlabelled)]

    def plain(w):
        def mean(rows, sign):
            return sum(math.log1p(math.exp(-sign * (sum(w[f] for f in row) + w[-1]))) for row in rows) / len(rows)
        return prior * mean(positive, 1), mean(unlabelled, -1) - prior * mean(positive, -1)

    missing, blaming, gradient = toxicity.risk(weights, *sparse, prior)
    assert (missing, blaming) == pytest.approx(plain(weights))
    step = 1e-5
    for k in range(width + 1):
        up, down = (plain(weights + d * np.eye(width + 1)[k]) for d in (step, -step))
        whole = (sum(up) - sum(down)) / (2 * step)
        back = -(up[1] - down[1]) / (2 * step)  # the turned gradient leads the second risk up again
        assert gradient[k] == pytest.approx(whole if blaming >= 0 else back, abs=1e-6)


def test_toxic_texts_are_found(spark):
    """Of the held-out rows: no few are found, and few clean ones are blamed."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, labels).filter("held_out").join(labels, "doc_id")
    toxic, found, clean, blamed = scored.agg(
        F.count_if(F.col("toxic") == 1), F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)),
        F.count_if(F.col("toxic") == 0), F.count_if((F.col("toxic") == 0) & (F.col("predicted") == 1))).first()
    assert toxic > 50 and found >= 0.8 * toxic
    assert blamed <= 0.02 * clean


def test_a_repeated_id_sends_one_text(spark):
    rows = [(1, f"text {i}", "en", "s") for i in range(500)] + [(i, "clean words here", "en", "s") for i in (2, 3, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wanted = spark.createDataFrame([(1, True), (1, False), (2, False), (9, True)], "doc_id long, p boolean")
    sent = labelled.sample_texts(docs, wanted, "doc_id", "text")
    assert sorted((r.p, r.t) for r in sent.collect()) == [(False, "clean words here"), (False, "text 0"), (True, "text 0")]


# The pipeline's stages

CLASHES = ["_row", "_sign", "_copy", "_copies", "_fp", "_component", "_least", "_tied", "_doc", "a.b", "fp", "host", "path", "size",
           "rank", "turn", "score", "log_odds", "again", "_h", "_p", "n", "s", "t", "p", "y"]


@pytest.fixture
def folder(spark, tmp_path):
    """A folder whose documents have odd rows and clashing names, and its labels."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None if n % 2 else "xx", None if n % 3 else "odd", None) for n, (i, t) in enumerate(ODD)],
                                docs.schema)
    more = docs.union(odd).select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in CLASHES])

    def write(rows):
        rows.write.parquet(str(tmp_path / "documents.parquet"))
        labels.write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    return write, more


def test_stages_on_odd_rows(spark, folder):
    import corpus_pipeline

    write, more = folder
    path, docs = write(more)
    columns = docs.columns
    key = F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in columns]))
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, docs, path)
        assert kept.columns == columns, name
        kept = kept.cache()
        # Whole rows of the table, their other columns untouched.
        assert kept.select(key).distinct().exceptAll(docs.select(key).distinct()).isEmpty(), name
        assert 0 < kept.count() <= 2 * docs.count()
        if name == "near duplicates":
            assert kept.filter("doc_id = 5 and text = 'a b c'").count() <= 1
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert last.count() == docs.count()


def test_stages_on_an_empty_table(spark, folder):
    import corpus_pipeline

    write, more = folder
    path, _ = write(more.limit(0))
    assert corpus_pipeline.run(spark, path).collect() == []
