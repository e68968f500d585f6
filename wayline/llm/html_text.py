"""Main text of web pages by differencing neighbours of a site.

A page becomes a list of lines, the texts of its blocks, with the part of the page each comes from.
Pages of a host are ordered by URL path. A page is held against the nearest page before and after it that
is no copy of it: an alignment by longest common subsequence of the lines finds the lines they share.
Outside of what the page itself names its article, a line shared with either goes. Inside, a line goes that it shares with
all pages around that are no copies, WITNESSES different ones at least, unless it belongs to a shared passage of LONG
words: articles quote each other, furniture is on every page. Lines in elements that are furniture by name go as
well. An article that holds little of the text is a teaser, and all is open text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from html import unescape
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import slices, small_batches

#: Pages before, and after, a page among which its neighbours are looked for; copies of it are passed over.
REACH = 4
#: Share of its text above which a page and another one count as copies.
COPIES = 0.8
#: Different pages that must all share a line of an article before it is furniture.
WITNESSES = 4
#: Words of a shared passage inside an article from which on it is content.
LONG = 40
#: An article with less than this share of the text that is left is a teaser.
TEASER = 0.25
#: Alignments of more line pairs are halved first, which gives an alignment of the same length.
HALVED = 20_000_000
#: Bytes of the pages of a part, about.
PART_BYTES = 16 << 20
PARTS = 20_000
KEY_TYPES = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
OUT_TYPES = (pa.int64(), pa.string(), pa.string())
MAIN, OPEN, CHROME = 0, 1, 2

#: Elements without text of their own, those that are furniture, blocks, and those that never have content.
_RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "svg", "math", "object", "canvas", "video", "audio", "select", "datalist", "head", "title"}
_CHROME = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "fieldset", "label", "input"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
          "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup",
          "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class, id and role that name furniture and reader comments.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|menubar|topbar|toolbar|"
    r"breadcrumb|breadcrumbs|sidebar|complementary|footer|contentinfo|masthead|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|comment|comments|"
    r"commentlist|disqus|respond|reply|replies|discussion|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|"
    r"pagination|pager|widget|skip|copyright)(?:$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header)(?:$|[\s_-])", re.I)
#: One piece of markup: comment, declaration, or tag with quoted attributes.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")


def page_lines(html: str) -> list[tuple[int, str]]:
    """(part of the page, text) of each block with text, in order; white space inside is one blank."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    state, held = OPEN, []

    def close():
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((state, text))

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in _BLOCK or name in _CHROME:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    # an element ends whatever was left open in it
                    if stack[i][1] != state or any(n in _BLOCK for n, _ in stack[i:]):
                        close()
                    state = stack[i][1]
                    del stack[i:]
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if name in _RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                if name == "head" and end is None:
                    continue
                if name in _BLOCK:
                    close()
                at = end.end() if end else size
            continue
        if name in _BLOCK or name in _CHROME:
            close()
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        before = state
        if state != CHROME:
            kind = " ".join(a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role", "aria-label") and (a or b or c))
            hidden = re.search(r"(?:^|\s)hidden(?:$|[\s=])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", attributes, re.I)
            # the header of an article is its title
            if (name in _CHROME and not (name == "header" and state == MAIN)) or hidden or (kind and name not in ("html", "body", "article", "main") and (_NAMES.search(kind) or _HEADER.search(kind))):
                new = CHROME
            elif name in ("article", "main") or re.search(r"\brole\s*=\s*[\"']?(?:main|article)\b", attributes, re.I):
                new = MAIN
            else:
                new = state
            if new != state:
                close()
                state = new
        stack.append((name, before))
    close()
    return out


def common_lines(a: list[str], b: list[str]) -> tuple[set[int], set[int]]:
    """Positions in a and in b of a longest common subsequence."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = set(range(i)) | set(range(len(a) - j, len(a))), set(range(i)) | set(range(len(b) - j, len(b)))
    one, two = a[i : len(a) - j], b[i : len(b) - j]
    for p, q in _halved(one, two):
        x.add(i + p)
        y.add(i + q)
    return x, y


def _row(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the common subsequence of all of b and the first 0, 1, .. lines of a; bits of a number stand for the lines of a."""
    place: dict[str, int] = {}
    for i, line in enumerate(a):
        place[line] = place.get(line, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for line in b:
        hit = row & place.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer((row ^ full).to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])


def _halved(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """A longest common subsequence in memory that grows with the lines: halves of b against the parts of a that suit them best."""
    if len(a) * len(b) <= HALVED or len(b) < 2:
        yield from _exact(a, b)
        return
    middle = len(b) // 2
    cut = int((_row(a, b[:middle]) + _row(a[::-1], b[:middle - 1 : -1])[::-1]).argmax())
    yield from _halved(a[:cut], b[:middle])
    for p, q in _halved(a[cut:], b[middle:]):
        yield cut + p, middle + q


def _exact(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """Bits of a number stand for the lines of a; a row of the alignment for each line of b."""
    if not a or not b:
        return
    place: dict[str, int] = {}
    for i, line in enumerate(a):
        place[line] = place.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for line in b:
        hit = row & place.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j = len(a), len(b)
    count = lambda k, n: n - (rows[k - 1] & ((1 << n) - 1)).bit_count() if k else 0
    now = count(j, i)
    while now:
        if count(j - 1, i) == now:
            j -= 1
        elif not rows[j - 1] >> (i - 1) & 1 and a[i - 1] == b[j - 1]:
            yield i - 1, j - 1
            i, j, now = i - 1, j - 1, now - 1
        else:
            i -= 1


class _Page:
    """A page that is held against others: its lines, and how much text it has."""

    def __init__(self, key: tuple, head: tuple, html: str, guest: bool):
        self.key, self.head, self.guest = key, head, guest
        self.lines = page_lines(html)
        self.texts = [t for _, t in self.lines]
        self.size = sum(len(t) for s, t in self.lines if s != CHROME)
        self.met: dict[int, tuple[set[int], bool]] = {}
        self.nr = 0

    def against(self, other: _Page) -> tuple[set[int], bool]:
        """Own lines shared with the other page, and whether it is a copy."""
        if other.nr not in self.met:
            # of equally long alignments, one that does not depend on who asks first
            one, two = (self, other) if self.nr < other.nr else (other, self)
            x, y = common_lines(one.texts, two.texts)
            for page, mate, own in ((one, two, x), (two, one, y)):
                same = sum(len(page.texts[i]) for i in own if page.lines[i][0] != CHROME)
                page.met[mate.nr] = own, same > COPIES * page.size
        return self.met[other.nr]


def furniture(page: _Page, before: list[_Page], after: list[_Page]) -> set[int]:
    """Lines of the page to delete, from the pages before and after it, nearest first."""
    def others() -> Iterator[_Page]:
        """The pages that are no copies of this one, in turns from either side."""
        sides = [[p for p in side if not page.against(p)[1]] for side in (before, after)]
        for i in range(REACH):
            yield from (side[i] for side in sides if len(side) > i)

    near = others()
    two = list(islice(near, 2))
    gone = {i for p in two for i in page.against(p)[0] if page.lines[i][0] != MAIN}
    shared = {i for i, (state, _) in enumerate(page.lines) if state == MAIN}
    apart: list[_Page] = []
    for p in chain(two, near):
        shared &= page.against(p)[0]
        if not shared:
            return gone
        if not any(p.against(q)[1] for q in apart):
            apart.append(p)
    return gone | _short_runs(page, shared) if len(apart) >= WITNESSES else gone


def _short_runs(page: _Page, shared: set[int]) -> set[int]:
    """The shared lines that are no part of a passage of LONG words; lines of other parts of the page don't interrupt one."""
    out, run = set(), []
    for i, (state, _) in [*enumerate(page.lines), (-1, (MAIN, ""))]:
        if state == MAIN and i in shared:
            run.append(i)
        elif state == MAIN:
            if sum(len(page.texts[k].split()) for k in run) < LONG:
                out |= set(run)
            run = []
    return out


def main_text(page: list[tuple[int, str]], shared: set[int]) -> str:
    """The article if the page names one that is more than a teaser, else all open lines; without furniture and shared lines."""
    left = [(s, t) for i, (s, t) in enumerate(page) if i not in shared and s != CHROME]
    main = sum(len(t) for s, t in left if s == MAIN)
    whole = main < TEASER * sum(len(t) for _, t in left)
    return "\n".join(t for s, t in left if s == MAIN or whole or not main)


def _differenced(pages: Iterator[_Page]) -> Iterator[tuple]:
    """(page id, url, text) of all pages but guests, which come in order with their guests around them."""
    held: list[_Page] = []
    done = 0  # pages of `held` that are finished

    def finish(i: int) -> Iterator[tuple]:
        page = held[i]
        if not page.guest:
            gone = furniture(page, held[max(0, i - REACH) : i][::-1], held[i + 1 : i + 1 + REACH])
            yield (*page.head, main_text(page.lines, gone))

    for nr, page in enumerate(pages):
        page.nr = nr
        if held and page.key != held[-1].key:
            for i in range(done, len(held)):
                yield from finish(i)
            held, done = [], 0
        held.append(page)
        if len(held) - done > REACH:
            yield from finish(done)
            done += 1
            if done > REACH:
                held.pop(0)
                done -= 1
    for i in range(done, len(held)):
        yield from finish(i)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every row, empty if there is none.

    Null html is an empty page, a null url belongs to no host and is paired with other such pages.
    Repeated rows come back each, and are copies of each other. Pages are taken whole, whatever their length.
    An empty table gives no rows. Other columns are not read. Pages are ordered by host, path, id and dealt to
    parts of about PART_BYTES; the REACH pages on either side of a border come along as guests, so a page has the
    same neighbours wherever the borders lie and however many pages its host has.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.substring_index(F.substring_index(F.substring_index(bare, "/", 1), "?", 1), "#", 1))
    path = F.substring_index(F.substring_index(F.substring(bare, F.length(host) + 1, F.lit(1 << 30)), "?", 1), "#", 1)
    order = ["host", "path", "key", "mark"]
    rows = rows.withColumns({"host": host, "path": path, "key": F.coalesce("page_id", F.lit(-(1 << 63))), "mark": F.xxhash64("html")})
    parts = int(max(1, min(PARTS, -(-(rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0) // PART_BYTES))))

    # of each range of the order, the first and last REACH keys: the ranges' borders and the guests on both sides
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, at = [], deque(maxlen=REACH), 0
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in order)):
                if at < REACH:
                    first.append(x)
                last.append(x)
                at += 1
        if at:
            kept = [*((*x, 0, i) for i, x in enumerate(first)), *((*x, 1, i) for i, x in enumerate(last))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), KEY_TYPES)], names=[*order, "end", "nr"])

    guests: dict[tuple, list[int]] = {}
    borders: list[tuple] = []
    if parts > 1:
        dealt = rows.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = dealt.mapInArrow(ends, "host string, path string, key bigint, mark bigint, end int, nr int").toArrow()  # 2 x REACH rows for each part
        keys = sorted({(x["host"].encode(), x["path"].encode(), x["key"], x["mark"]) for x in found.to_pylist()})
        firsts = sorted({(x["host"].encode(), x["path"].encode(), x["key"], x["mark"]) for x in found.to_pylist() if x["end"] == 0 and x["nr"] == 0})
        borders = firsts[1:]
        for n, border in enumerate(borders):
            i = bisect_left(keys, border)
            for k in keys[max(0, i - REACH) : i]:
                guests.setdefault(k, []).append(n + 1)
            for k in keys[i : i + REACH]:
                guests.setdefault(k, []).append(n)
    plan = spark.sparkContext.broadcast((borders, guests))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders, guests = plan.value
        names = ["page_id", "url", "html", *order, "part", "guest"]
        for b in slices(batches, "html"):
            keys = [(h.encode(), p.encode(), k, m) for h, p, k, m in zip(*(b.column(c).to_pylist() for c in order))]
            own = [bisect_right(borders, k) for k in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array([False] * len(own))], names=names)
            also = [(i, n) for i, k in enumerate(keys) for n in guests.get(k, ()) if n != own[i]]
            if also:
                some = b.take(pa.array([i for i, _ in also]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([n for _, n in also], pa.int32()), pa.array([True] * len(also))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed():
            for b in slices(batches, "html"):
                for part, host, i, url, html, guest in zip(*(b.column(c).to_pylist() for c in ("part", "host", "page_id", "url", "html", "guest"))):
                    yield _Page((part, host), (i, url), html or "", guest)

        held: list[tuple] = []
        size = 0
        for row in _differenced(parsed()):
            held.append(row)
            size += len(row[2])
            if len(held) >= 500 or size > PART_BYTES // 8:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), OUT_TYPES)], names=["page_id", "url", "text"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), OUT_TYPES)], names=["page_id", "url", "text"])

    kinds = "page_id bigint, url string, html string, host string, path string, key bigint, mark bigint, part int, guest boolean"
    dealt = rows.select("page_id", "url", "html", *order).mapInArrow(deal, kinds).repartitionById(parts, F.col("part")).sortWithinPartitions("part", *order, "html")
    return dealt.mapInArrow(run, "page_id bigint, url string, text string")
