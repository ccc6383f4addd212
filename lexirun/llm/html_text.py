"""Main text of web pages by nearest-URL differencing, with markup as a second witness for each line.

Every page is paired with the page of its host whose URL path is nearest, their lines are aligned by a longest
common subsequence, and shared lines are deleted. Alone that can't give right results: an article loses the lines
that its neighbour quotes too, and a menu that differs from page to page stays. So markup speaks for single lines,
never for a page: lines within an article or main element outlive being shared, lines in elements for menus,
adverts and the like go even if they aren't, and of all other lines differencing decides.
"""

from __future__ import annotations

import html as entities
import os.path
import re
import zlib
from collections import Counter
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, spread_join, spread_of
from .ranking import ranked

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Element names by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
#: Of the raw ones, those of which only the tag goes where none closes them.
EMBEDDED = frozenset("noscript template iframe svg".split())
DROPPED = frozenset("head nav header footer aside form button select option fieldset object canvas dialog menu audio video map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HOLDS = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section table td th ul".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
HEADER_WORDS = frozenset("header masthead".split())
#: Words that name what isn't the article, in classes, ids and roles, and words that may stand beside them in one name.
CHROME_WORDS = COMMENT_WORDS | HEADER_WORDS | frozenset(
    "ad ads advert adverts advertisement adsense alert banner breadcrumb breadcrumbs consent contentinfo complementary cookie cookies dialog footer gdpr menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
PLAIN_WORDS = frozenset(
    "area articles bar block body bottom box button buttons col column container content count form global group holder icons inner item items left link links list main media mobile outer page panel policy post posts primary reader right row secondary section site slot sticky stories thread top unit user view wrap wrapper zone".split()
)
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

#: What markup says of a line. GONE: chrome, whatever the neighbour has. ASIDE: an article within chrome, which
#: counts only on a page without another. OPEN: nothing. MAIN, ARTICLE: within such an element. DOUBTFUL: within one,
#: but in a part that is named in a doubtful way.
GONE, ASIDE, OPEN, MAIN, ARTICLE, DOUBTFUL = range(6)
#: Why a line goes, or KEPT.
KEPT, BY_MARKUP, BY_DIFFERENCE, BY_BOTH = range(4)
#: Bits of alignment held at a time; longer pages are halved until they fit.
ALIGNED = 1 << 26


@lru_cache(4096)
def _names(attributes: str) -> tuple[bool, bool, bool, bool, bool, bool]:
    """Whether class, id and role say: chrome, chrome by class or role alone, comments, header, something with a word of chrome in it, main."""
    chrome = named = comments = header = some = main = False
    for m in ATTRIBUTE.finditer(attributes):
        kind = m[1].lower()
        for name in (m[2] or m[3] or m[4] or "").split():
            words = {w for part in CAMEL.split(name) for w in SPLIT.split(part.lower()) if w}
            main |= kind == "role" and words == {"main"}
            found = words & CHROME_WORDS
            if not found:
                continue
            some = True
            if words <= CHROME_WORDS | PLAIN_WORDS:
                if found <= HEADER_WORDS:
                    header = True
                else:
                    chrome = True
                    named |= kind != "id"
                    comments |= bool(found & COMMENT_WORDS)
    return chrome, named, comments, header, some, main


def lines_of(page: str) -> list[tuple[str, int]]:
    """The text lines of a page in order, each with what markup says of it (GONE to DOUBTFUL).

    A line is the text of one block element, with character references decoded and white space squeezed to one
    space. Broken markup is read as far as it goes: what isn't closed ends with what holds it. The text of scripts,
    styles and of buttons and the like inside a line is in none.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int, bool, bool]] = []  # element, zone, role if it isn't the zone's (or -1), for good, muted
    open_: Counter[str] = Counter()
    zone, role, good, muted = OPEN, -1, False, False

    def end_line() -> None:
        if parts:
            if line := " ".join("".join(parts).split()):
                out.append((line, zone if role < 0 else role))
            parts.clear()

    def pop_to(k: int) -> None:
        nonlocal zone, role, good, muted
        open_.subtract(x[0] for x in stack[k:])
        del stack[k:]
        zone, role, good, muted = stack[-1][1:] if stack else (OPEN, -1, False, False)

    at, size, last = 0, len(page), page.rfind(">")
    unclosed: set[str] = set()  # elements whose closing tag doesn't come any more
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not muted:
            parts.append(entities.unescape(page[at:lt]))
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = TAG.match(page, lt) if lt < last else None
        if m is None:
            if lt + 1 < size and (page[lt + 1].isalpha() or page[lt + 1] == "/") and lt > last:
                break  # a tag cut off by the end of the page
            if not muted:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name, attributes = m[1] or m[4] or "", (m[2] or m[5]).lower(), m[3] or m[6] or ""
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            end_line()
        if closing:
            for k in range(len(stack) - 1, -1, -1) if open_[name] else ():
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if stack[k][0] in HOLDS and name not in HOLDS:
                    break
            continue
        if name in VOID:
            continue
        if name in RAW:
            if name in unclosed or name == "svg" and page[at - 2] == "/":
                continue
            end = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, at)
            if end is not None:
                at = end.end()
            elif name in EMBEDDED:
                unclosed.add(name)
            else:
                at = size
            continue
        for k in range(len(stack) - 1, -1, -1) if any(open_[x] for x in CLOSES.get(name, ())) else ():
            if stack[k][0] in CLOSES[name]:
                pop_to(k)
                break
            if stack[k][0] in HOLDS:
                break
        chrome, named, comments, header, some, main = _names(attributes) if attributes else (False,) * 6
        within = zone > OPEN
        here, now, final, mute = zone, role, good, muted
        whole = name in ("html", "body", "main") or name == "article" and not within
        if not good:
            if name in DROPPED and not (name == "header" and within):
                now, final = GONE, True
            elif whole or name in HEADINGS and within:
                if role == GONE and name in ("article", "main"):
                    now = ASIDE
                elif role == DOUBTFUL:
                    now = -1
            elif role != GONE:
                if comments or chrome and (named or not within) or header and not within:
                    now, final = GONE, comments
                elif within and role != ASIDE and (name == "header" or some and name in BLOCK):
                    now = DOUBTFUL
        if name == "article":
            here = ARTICLE
        elif name == "main" or main:
            here = max(zone, MAIN)
        if now == GONE and role != GONE and name not in BLOCK:
            mute = True
        stack.append((name, here, now, final, mute))
        open_[name] += 1
        zone, role, good, muted = stack[-1][1:]
    end_line()
    return out


def _rows(a: list, b: list) -> list[int]:
    """For each beginning of a, as a number of len(b) bits, where (0) one more element of b makes the longest common subsequence longer."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    state, rows = full, []
    for x in a:
        both = state & places.get(x, 0)
        state = (state + both | state - both) & full
        rows.append(state)
    return rows


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of a and each beginning of b."""
    state = (_rows(a, b) or [(1 << len(b)) - 1])[-1]
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list, b: list) -> set[int]:
    """The places in a of one longest common subsequence of a and b: bit-parallel, in room that doesn't grow with their product."""
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.add(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.add(a1)
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) > ALIGNED and a1 - a0 > 1:
            half = (a0 + a1) // 2
            ahead, behind = _lengths(a[a0:half], b[b0:b1]), _lengths(a[half:a1][::-1], b[b0:b1][::-1])[::-1]
            at = b0 + int(np.argmax(ahead + behind))
            todo += [(a0, half, b0, at), (half, a1, at, b1)]
            continue
        rows = _rows(a[a0:a1], b[b0:b1])
        i, j = a1 - a0, b1 - b0
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if i and not rows[i - 1] >> (j - 1) & 1:
                continue
            j -= 1
            found.add(a0 + i)
    return found


def digests(lines: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x in lines]


def verdicts(roles: list[int], shared: set[int] | None) -> list[int]:
    """KEPT, or why it goes, for each line of a page by its role and the places shared with the neighbour (None: it has none).

    A shared line goes unless it is ARTICLE, or MAIN on a page without ARTICLE lines. A line that isn't shared
    stays unless it is GONE or ASIDE; on a page without neighbour OPEN lines go as well if it has MAIN or ARTICLE ones.
    A page with neither, but with an article in its chrome, has that for its article.
    """
    best = max((r for r in roles if r <= ARTICLE), default=OPEN)
    if best <= OPEN and ASIDE in roles:
        roles, best = [ARTICLE if r == ASIDE else r for r in roles], ARTICLE
    out = []
    for i, r in enumerate(roles):
        same = shared is not None and i in shared
        if r in (GONE, ASIDE):
            out.append(BY_BOTH if same else BY_MARKUP)
        elif r == ARTICLE or r == MAIN == best:
            out.append(KEPT)
        elif same:
            out.append(BY_DIFFERENCE)
        else:
            out.append(BY_MARKUP if r == OPEN and shared is None and best > OPEN else KEPT)
    return out


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host and path of url, without scheme, query, fragment and closing slash; empty if url has none."""
    try:
        parts = urlsplit((url or "").strip())
        return parts.netloc.lower(), parts.path.rstrip("/")
    except ValueError:
        return "", ""


def _raw(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))


def _row_key(page_id, url: str | None, html: str | None) -> bytes:
    """Names a row by what is in it, so that it has one name however often it is read; equal rows have equal texts."""
    return xxhash.xxh3_128_digest(repr((page_id, url, html)).encode("utf-8", "replace"))


def _outlines(raw: DataFrame) -> DataFrame:
    """For each distinct row, cut: key, how many rows it stands for, host, path, the digests of its lines, and a hash of page_id and these."""

    def outlined(batches):
        names = ["key", "host", "path", "digests", "minor", "same"]
        for b in slices(batches, 256):
            cols = [[] for _ in names]
            for i, u, h in zip(b.column(0), b.column(1), b.column(2), strict=True):
                i, u, h = i.as_py(), u.as_py(), h.as_py()
                found = digests([x for x, _ in lines_of(h or "")])
                same = xxhash.xxh3_64_intdigest(np.array(found, np.int64).tobytes())
                minor = xxhash.xxh3_64_intdigest(repr(i).encode(), seed=same)
                for col, value in zip(cols, (_row_key(i, u, h), *host_and_path(u), found, minor - (1 << 63), same - (1 << 63)), strict=True):
                    col.append(value)
            types = [pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    rows = raw.mapInArrow(outlined, "key binary, host string, path string, digests array<bigint>, minor bigint, same bigint")
    rest = [F.first(c).alias(c) for c in rows.columns if c != "key"]
    return cut(rows.groupBy("key").agg(F.count("*").alias("rows"), *rest))


def _nearest(outlines: DataFrame) -> DataFrame:
    """key and near, the digests of the lines of its neighbour, for the pages that have one."""
    keys = outlines.filter("host <> ''").select("key", "host", "path", "same", F.encode(F.concat("host", F.lit("\0"), "path"), "utf-8").alias("major"), "minor", F.lit(1).cast("long").alias("weight"))
    order = cut(ranked(cut(keys)).select("key", "host", "path", "same", "rank"))
    after = order.select((F.col("rank") - 1).alias("rank"), F.col("host"), F.col("key").alias("key2"), F.col("path").alias("path2"), F.col("same").alias("same2"))

    def common(batches):
        for b in batches:
            n = [len(os.path.commonprefix([x.as_py(), y.as_py()])) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["key", "key2", "common"])

    pairs = order.join(after, ["rank", "host"]).filter("same <> same2").select("key", "key2", "path", "path2").mapInArrow(common, "key binary, key2 binary, common bigint")
    both = pairs.select("key", F.col("key2").alias("near"), "common", F.lit(0).alias("first")).unionByName(pairs.select(F.col("key2").alias("key"), F.col("key").alias("near"), "common", F.lit(1).alias("first")))
    nearest = both.groupBy("key").agg(F.max_by("near", F.struct("common", "first")).alias("near_key"))
    return nearest.join(outlines.select(F.col("key").alias("near_key"), F.col("digests").alias("near")), "near_key").select("key", "near")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, how many lines the neighbour shares, and how many went by_markup, by_difference, by_both.

    A page's neighbour is, of the two next to it in the order of host and path, the one of the same host with the
    longer common path beginning (the earlier if equally long); one with the very same lines is a copy, which tells
    nothing, and no neighbour. verdicts() says which lines go. A page without host has no neighbour, one without html
    an empty text, an empty table gives an empty one. Pages of any length are read whole. Ids may be null or come
    twice; pages with equal paths follow each other by a hash of id and text, rows that repeat count once; other
    columns are ignored, whatever their names.

    Pages are parsed twice, first for the outlines, then for the text: so only the lines, packed, are shuffled, and
    none is written.
    """
    raw = _raw(pages, id_col, url_col, html_col)
    kind = raw.schema["page_id"].dataType.simpleString()
    outlines = _outlines(raw)
    total = max(1, outlines.agg(F.sum("rows")).first()[0] or 0)
    copies = spread_of(outlines.select("key", "rows"), "rows", total)

    def packed(batches):
        for b in slices(batches, 256):
            found = [lines_of(h.as_py() or "") for h in b.column(2)]
            keys = [_row_key(i.as_py(), u.as_py(), h.as_py()) for i, u, h in zip(b.column(0), b.column(1), b.column(2), strict=True)]
            lines = [zlib.compress("\n".join(x for x, _ in f).encode("utf-8", "replace")) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(lines, pa.binary()), pa.array([bytes(r for _, r in f) for f in found], pa.binary())], names=["page_id", "url", "key", "lines", "roles"])

    def judged(batches):
        for b in slices(batches, 256):
            texts, counts = [], [[], [], [], []]
            for x, r, n in zip(b.column(2), b.column(3), b.column(4), strict=True):
                roles, near = list(r.as_py()), n.as_py()
                lines = zlib.decompress(x.as_py()).decode().split("\n") if roles else []
                shared = None if near is None else shared_lines(digests(lines), near)
                why = verdicts(roles, shared)
                texts.append("\n\n".join(line for line, w in zip(lines, why, strict=True) if w == KEPT))
                for c, n in zip(counts, (len(shared or ()), *map(why.count, (BY_MARKUP, BY_DIFFERENCE, BY_BOTH))), strict=True):
                    c.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), *[pa.array(c, pa.int32()) for c in counts]], names=["page_id", "url", "text", "shared", "by_markup", "by_difference", "by_both"])

    rows = raw.mapInArrow(packed, f"page_id {kind}, url string, key binary, lines binary, roles binary")
    met = spread_join(rows, _nearest(outlines), ["key"], copies)
    return met.select("page_id", "url", "lines", "roles", "near").mapInArrow(judged, f"page_id {kind}, url string, text string, shared int, by_markup int, by_difference int, by_both int")
