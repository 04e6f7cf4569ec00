"""Main text of web pages by differencing against the page with the nearest url.

A page becomes lines of text, each with the region of markup it lies in. Pages
of a host stand in the order of their url paths, copies as one; each is aligned
with its neighbour there by the longest common subsequence of all their lines, and lines
that both have are deleted as the site's own.

Pages also repeat each other's articles, and sites choose menus at random, so
sharing alone neither spares the first nor finds the second. Markup corrects it
where it speaks: lines in menus, footers, adverts and the like go even if not
shared, and lines inside an article or main element stay even if shared. All other
lines, those beside an article too, go if they are shared and stay if not.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowline import settings
from stowline.llm.common import slices
from stowline.llm.urls import url_host, url_path
from stowline.operators.ordinal import with_ordinal
from stowline.sources.positions import at_positions
from stowline.sources.staging import most_rows, stage

OPEN, CONTENT, SITE = 0, 1, 2
#: While a page is parsed: inside an element of a layout name, and an article or main element in there.
_NAMED, _HELD = 3, 4

_SILENT = {"script", "style", "noscript", "template", "head", "svg", "iframe", "object", "select",
           "option", "textarea", "button", "canvas", "audio", "video"}
_SITE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_SITE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar",
               "form", "alert", "dialog"}
_SITE_NAMES = {"nav", "navbar", "navigation", "menu", "header", "footer", "sidebar", "aside", "notice",
               "notices", "cookie", "cookies", "consent", "banner", "ad", "ads", "advert", "adverts",
               "advertisement", "sponsor", "sponsored", "promo", "newsletter", "subscribe", "signup",
               "share", "sharing", "social", "related", "comment", "comments", "disqus", "breadcrumb",
               "breadcrumbs", "popup", "modal", "widget", "login", "pagination", "skip"}
_CONTENT_TAGS = {"article", "main"}
#: An open head ends where any other element or text begins.
_HEAD_TAGS = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script",
              "style", "template", "title"}
#: Matches for each line up to which all are kept, and lines whose places are remembered as numbers.
MATCHES, FREQUENT = 8, 256
#: Pages whose neighbours are found together.
BLOCK = 256
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
           "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
           "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An open paragraph ends where one of these begins.
_ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1",
                   "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre",
                   "section", "table", "ul"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = {"ul", "ol", "dl", "table", "tbody", "thead", "tr", "div", "article", "main", "section", "body"}


class _Lines(HTMLParser):
    """Blocks of text with the region that markup puts them in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = [("", OPEN, False)]  # tag, region, silent
        self.lines: list[tuple[str, int]] = []
        self.parts: list[str] = []

    def _break(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.stack[-1][1]))
        self.parts = []

    def _close(self, at: int) -> None:
        if any(tag not in _INLINE for tag, _, _ in self.stack[at:]):
            self._break()
        del self.stack[at:]

    def _innermost(self, tags: set[str], until: set[str]) -> int:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] in tags:
                return at
            if self.stack[at][0] in until:
                break
        return 0

    def _leave_head(self) -> None:
        if self.stack[-1][0] == "head":
            self._close(len(self.stack) - 1)

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.handle_endtag("head")
        elif tag not in _HEAD_TAGS:
            self._leave_head()
        if tag not in _INLINE:
            implied = self._innermost({"p"}, _HOLDERS) if tag in _ENDS_PARAGRAPH else (
                self._innermost(_SIBLINGS[tag], _HOLDERS - {tag, "tr"} if tag == "tr" else _HOLDERS)
                if tag in _SIBLINGS else 0)
            if implied:
                self._close(implied)
            if tag == "br":
                self.parts.append(" ")
                return
            self._break()
        if tag in _VOID:
            return
        _, region, silent = self.stack[-1]
        self.stack.append((tag, _region(tag, attrs, region), silent or tag in _SILENT))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = self._innermost({tag}, set())
        if at:
            self._close(at)

    def handle_data(self, data):
        if data.strip():
            self._leave_head()
        if not self.stack[-1][2]:
            self.parts.append(data)


def _region(tag: str, attrs: list[tuple[str, str | None]], around: int) -> int:
    """Tags and roles of a site's own parts bind all below them, layout names all but article and main."""
    roles = {value.lower() for name, value in attrs if name == "role" and value}
    if around == SITE or tag in _SITE_TAGS or not _SITE_ROLES.isdisjoint(roles):
        return SITE
    if tag in _CONTENT_TAGS or not _CONTENT_TAGS.isdisjoint(roles):
        return _HELD if around in (_NAMED, _HELD) else CONTENT
    names = {part for name, value in attrs if name in ("class", "id") and value for part in value.lower().split()}
    if tag not in ("body", "html") and not _SITE_NAMES.isdisjoint(names):
        return SITE if around in (CONTENT, _HELD) else _NAMED
    return around


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """(text, region) of each block of a page, in page order, white space turned into single spaces.

    Article and main elements inside an element of a layout name are content
    where the page has no others; beside others they are teasers or comments.
    """
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._break()
    held = SITE if any(region == CONTENT for _, region in parser.lines) else CONTENT
    return [(text, {_NAMED: SITE, _HELD: held}.get(region, region)) for text, region in parser.lines]


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Positions in ``own`` of a longest common subsequence with ``other``.

    Where lines match in many places, common ends are taken off and the rest is
    halved where the two halves share most (Hirschberg), until the matches of a
    part are few; memory stays linear in the lines.
    """
    found: list[int] = []
    todo = [(0, len(own), 0, len(other))]
    while todo:
        a, b, c, d = todo.pop()
        counts = Counter(other[c:d])
        if b - a < 2 or sum(counts[line] for line in own[a:b]) <= MATCHES * (b - a + d - c):
            found += [a + at for at in _rising_partners(own[a:b], other[c:d])]
            continue
        while a < b and c < d and own[a] == other[c]:
            found.append(a)
            a, c = a + 1, c + 1
        while a < b and c < d and own[b - 1] == other[d - 1]:
            b, d = b - 1, d - 1
            found.append(b)
        if b - a < 2:
            todo.append((a, b, c, d))
            continue
        half = (a + b) // 2
        left = _shared_counts(own[a:half], other[c:d])
        right = _shared_counts(own[half:b][::-1], other[c:d][::-1])[::-1]
        cut = c + int((left + right).argmax())
        todo += [(a, half, c, cut), (half, b, cut, d)]
    return sorted(found)


def _shared_counts(own: list[int], other: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``own`` and each beginning of ``other``.

    The lengths are the zero bits of one number (Crochemore et al.). The places
    of the most frequent lines are remembered as numbers too, of the others as lists.
    """
    n = len(other)
    places: dict[int, list[int]] = {line: [] for line in own}
    for at, line in enumerate(other):
        if line in places:
            places[line].append(at)

    def mask(line: int) -> int:
        bits = bytearray(n // 8 + 1)
        for at in places[line]:
            bits[at >> 3] |= 1 << (at & 7)
        return int.from_bytes(bits, "little")

    masks = {line: mask(line) for line in nlargest(FREQUENT, places, key=lambda line: len(places[line]))}
    full = (1 << n) - 1
    rest = full
    for line in own:
        if places[line]:
            hits = rest & (masks[line] if line in masks else mask(line))
            rest = (rest + hits | rest - hits) & full
    bits = np.frombuffer(rest.to_bytes(n // 8 + 1, "little"), np.uint8)
    return np.append(0, np.cumsum(1 - np.unpackbits(bits, count=n, bitorder="little").astype(np.int64)))


def _rising_partners(own: list[int], other: list[int]) -> list[int]:
    """The same as :func:`shared_lines`, with memory for each match.

    Matching positions are taken in order and the longest rising run of partners
    is kept (patience order).
    """
    places: dict[int, list[int]] = {}
    for at in range(len(other) - 1, -1, -1):
        places.setdefault(other[at], []).append(at)
    ends: list[int] = []  # the least partner that ends a run of each length
    tails: list[int] = []
    links: list[tuple[int, int]] = []  # own position, link before
    for at, line in enumerate(own):
        for partner in places.get(line, ()):
            length = bisect_left(ends, partner)
            links.append((at, tails[length - 1] if length else -1))
            if length == len(ends):
                ends.append(partner)
                tails.append(len(links) - 1)
            else:
                ends[length], tails[length] = partner, len(links) - 1
    found, link = [], tails[-1] if tails else -1
    while link >= 0:
        at, link = links[link]
        found.append(at)
    return found[::-1]


def page_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row; ``text`` is empty if nothing is left.

    A page's neighbour is the one before it by (path, url, page_id) on its host,
    or the one after it for the first. Pages of a host that differ in nothing but lines that
    markup excludes stand together at the first of them, which is aligned for all; so no page is
    held against a copy of itself, and copies have the same text. A page alone on its host,
    copies aside, shares nothing, nor do urls without a host. Null and empty pages have the
    empty text; repeated rows are pages of their own. ``n_shared`` counts the lines that markup does
    not exclude and the neighbour has too, deleted or spared. Other columns are ignored.
    """
    kept = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
                        F.col(html).alias("html"))
    parsed = stage(kept.mapInArrow(_parse, _PARSED).withColumn("row", F.monotonically_increasing_id()), "lines")
    left = _with_shared(parsed, _shared(parsed.select("row", "page_id", "url", "host", "path", "sequence", "hashes", "regions")))
    flags = F.transform(F.split(F.coalesce("_new", F.lit("")), ""), lambda flag: flag == "1")
    left = left.select("page_id", "url", "lines", "open", flags.alias("shared"))
    gone = F.zip_with("open", "shared", lambda open_, shared: open_ & shared)
    # Lines that go become null, which joining leaves out.
    spare = F.zip_with("lines", gone, lambda line, goes: F.when(~F.coalesce(goes, F.lit(False)), line))
    return left.select("page_id", "url", F.array_join(spare, " ").alias("text"),
                       F.size(F.filter("shared", lambda flag: flag)).cast("long").alias("n_shared")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


_PARSED = "page_id long, url string, host string, path string, lines array<string>, open array<boolean>, " \
          "hashes array<long>, regions binary, sequence binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that markup does not exclude; ``open`` marks those that differencing may delete.

    ``hashes`` and ``regions`` are of all lines. ``sequence`` is the same for pages of a host
    of the same lines that markup does not exclude.
    """
    for batch in slices(batches):
        texts, opens, hashes, regions, sequences = [], [], [], [], []
        for html, host in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = lines_of(html)
            hashes.append([xxhash.xxh64_intdigest(text) - (1 << 63) for text, _ in lines])
            regions.append(bytes(region for _, region in lines))
            texts.append([text for text, region in lines if region != SITE])
            opens.append([region == OPEN for _, region in lines if region != SITE])
            own = [h for h, (_, region) in zip(hashes[-1], lines, strict=True) if region != SITE]
            sequences.append(xxhash.xxh3_128_digest(
                (host or "").encode() + b"\0" + bytes(opens[-1]) + np.array(own, "<i8").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(texts, pa.list_(pa.string())), pa.array(opens, pa.list_(pa.bool_())),
             pa.array(hashes, pa.list_(pa.int64())), pa.array(regions, pa.binary()), pa.array(sequences, pa.binary())],
            ["page_id", "url", "host", "path", "lines", "open", "hashes", "regions", "sequence"])


def _shared(rows: DataFrame) -> DataFrame:
    """(sequence, _new): for each line that markup does not exclude, 1 if the neighbour has it too, else 0; staged.

    Pages that share none have no row. Pages of a host with the same sequence are one row, at the place
    of the first of them. The rows are numbered in url order over ranges, so a host of any
    size is spread over tasks; neighbours meet in blocks of numbers, each with the rows at
    its two edges, carrying hashes of lines only.
    """
    place = ["path", "url", "page_id", "row"]
    kinds = rows.filter("host != ''").groupBy("host", "sequence").agg(
        F.min(F.struct(*place, "hashes", "regions")).alias("first")).select("host", "sequence", "first.*")
    placed = with_ordinal(kinds, ["host", *place], "at", None).drop(*place)
    block = ((F.col("at") - 1) / BLOCK).cast("long")
    edges = F.when(F.col("at") % BLOCK == 0, F.array(block, block + 1)).when(
        F.col("at") % BLOCK == 1, F.array(block, block - 1)).otherwise(F.array(block))
    line = Window.partitionBy("_in").orderBy("at")
    paired = placed.withColumns({"_own": block, "_in": F.explode(edges)}).withColumns({
        "other": F.when(F.lag("host").over(line) == F.col("host"), F.lag("hashes").over(line)).when(
            F.lead("host").over(line) == F.col("host"), F.lead("hashes").over(line))}).filter("_own = _in")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for own, regions, other in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                flags = bytearray(b"0" * len(own))
                for at in shared_lines(own, other):
                    flags[at] = ord("1")
                found.append(bytes(flag for flag, region in zip(flags, regions, strict=True) if region != SITE).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["sequence", "_new"])

    pairs = paired.filter("size(hashes) > 0 and size(other) > 0").select("sequence", "hashes", "regions", "other")
    return stage(pairs.mapInArrow(align, "sequence binary, _new string").filter("instr(_new, '1') > 0"), "shared")


def _with_shared(parsed: DataFrame, shared: DataFrame) -> DataFrame:
    """``parsed`` (staged) plus ``_new``, its flags of ``shared``, without a shuffle of texts where that can be had."""
    if most_rows(shared) <= settings.broadcast_rows(parsed.sparkSession):
        return parsed.join(F.broadcast(shared), "sequence", "left")
    found = at_positions(parsed, shared, "sequence")
    return parsed.join(shared, "sequence", "left") if found is None else found
