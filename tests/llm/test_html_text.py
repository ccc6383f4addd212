import os.path
import random
import re
from html.parser import HTMLParser

import pytest

from lexirun.llm import html_text
from lexirun.llm.html_text import ARTICLE, ASIDE, BY_BOTH, BY_DIFFERENCE, BY_MARKUP, DOUBTFUL, GONE, KEPT, MAIN, OPEN, extract_text, host_and_path, shared_lines, verdicts
from lexirun.llm.queries import op2_page_differencing


def lines_of(page):
    """Those that markup alone doesn't drop."""
    return [x for x in html_text.lines_of(page) if x[1] != GONE]


def text_of(page, neighbour=None):
    """The text of a page beside another."""
    lines, roles = zip(*html_text.lines_of(page), strict=True)
    why = verdicts(list(roles), None if neighbour is None else shared_lines(list(lines), [x for x, _ in html_text.lines_of(neighbour)]))
    return [x for x, w in zip(lines, why, strict=True) if w == KEPT]


def test_zones():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body class="menu">
    <header>head</header><nav><ul><li>menu</ul></nav><!-- <p>no</p> --><div class="ad-box">ad</div><div id="cookie-notice">ok?</div>
    <article><h1>Title &amp; more</h1><p><b>One<br>two &lt;x&gt; &#233;&nbsp;y<p>Three <i>four</i>five</p><form><input>send</form><aside>by</aside>
    <ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article><div class=comments><article>comment</article></div><footer>&copy;</footer></body>"""
    assert lines_of(page) == [(x, ARTICLE) for x in ("Title & more", "One two <x> é y", "Three fourfive", "a", "b", "c", "d")]


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ("", []), ("plain", ["plain"]), ("a < b > c", ["a < b > c"]), ("<p>a<p>b", ["a", "b"]), ("<p>x <b", ["x"]), ("<p>a</div>b</p>", ["a", "b"]),
        ("<script>never closed <p>x", []), ("<p title='a>b'>c", ["c"]), ('<p title="a>c', ["c"]), ("<nav><div>x</nav>y", ["y"]), ("<li class=ad>no<li>yes", ["yes"]),
        ("<div class='sidebar'><article>kept</article></div>", ["kept"]), ("&am &amp", ["&am &"]), ("<p>  a \t b\n</p>", ["a b"]),
    ],
)
def test_markup(page, lines):
    assert [x for x, _ in lines_of(page)] == lines


@pytest.mark.parametrize("tag", ["<svg/>", '<svg viewBox="0 0 1 1" />', "<SVG\n/>", "<svg>", "<iframe src=x>", "<template>", "<noscript>"])
def test_embedded_elements_without_end(tag):
    assert lines_of(f"<article><p>a</p>{tag}<p>b</p></article>") == [("a", ARTICLE), ("b", ARTICLE)]
    assert lines_of("<article><p>a<svg><text>x</text></svg>b<svg/>c</p></article>") == [("abc", ARTICLE)]
    assert lines_of("<p>a" + tag * 50_000) == [("a", OPEN)]


def test_hostile_pages_stay_linear():
    for page in ("<" * 200_000, "<a " * 100_000, "<p>" * 100_000, '<a "' * 50_000 + ">", "<!--" * 100_000, "&" * 200_000, "<div class=ad>" * 20_000):
        lines_of(page)


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (["abcd"[rng.randrange(4)] for _ in range(rng.randint(0, 9))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = shared_lines(a, b)
        left = iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in left for i in sorted(found))


@pytest.mark.parametrize("size", [1, 7, 60, 1 << 26])
def test_alignment_in_parts(monkeypatch, size):
    monkeypatch.setattr(html_text, "ALIGNED", size)
    test_longest_common_subsequence()
    rng = random.Random(size)
    a, b = ([rng.randrange(3) for _ in range(90)] for _ in "ab")
    found, left = shared_lines(a, b), iter(b)
    assert all(a[i] in left for i in sorted(found))
    monkeypatch.setattr(html_text, "ALIGNED", 1 << 26)
    assert len(found) == len(shared_lines(a, b))


def test_long_pages_align():
    assert len(shared_lines(["x"] * 30_000, ["x"] * 20_000 + ["y"] * 10)) == 20_000
    assert len(shared_lines([k % 7 for k in range(20_000)], [k % 5 for k in range(20_000)])) > 10_000


def test_verdicts():
    roles = [GONE, OPEN, ARTICLE, ARTICLE, DOUBTFUL, DOUBTFUL, MAIN, MAIN, OPEN, GONE]
    assert verdicts(roles, {0, 2, 4, 6, 9}) == [BY_BOTH, KEPT, KEPT, KEPT, BY_DIFFERENCE, KEPT, BY_DIFFERENCE, KEPT, KEPT, BY_BOTH]
    assert verdicts([OPEN, MAIN, MAIN, OPEN], {2, 3}) == [KEPT, KEPT, KEPT, BY_DIFFERENCE]
    assert verdicts([OPEN, MAIN, ARTICLE, GONE], None) == [BY_MARKUP, KEPT, KEPT, BY_MARKUP]
    assert verdicts([OPEN, ASIDE], set()) == [KEPT, KEPT] and verdicts([ARTICLE, ASIDE], set()) == [KEPT, BY_MARKUP]
    assert verdicts([], None) == []
    assert host_and_path("HTTP://A.b/c/d/?q=1#x") == ("a.b", "/c/d") and host_and_path(None) == ("", "") and host_and_path("http://[") == ("", "")


PAGES = [  # a page, its neighbour, and the text that a reader would mark
    ("<main><p>Story.</p><article><p>Read next</p></article></main>", None, ["Story.", "Read next"]),
    ("<article><header><h1>Title</h1><nav>skip</nav></header><section class='search-engines'><p>About search engines</p></section><div class='share-prices'><p>Share prices fell</p></div></article>", None, ["Title", "About search engines", "Share prices fell"]),
    ("<div class='siteNav'>a</div><div class='topBanner1'>b</div><div class='ad-box'>c</div><article><p>Text</p><div class='share-buttons'>d</div></article>", None, ["Text"]),
    ("<h1>Head</h1><article><p>One</p></article><div>Legal</div>", "<h1>Other</h1><article><p>Two</p></article><div>Legal</div>", ["Head", "One"]),
    ("<h1>Head</h1><article><p>One</p></article><div>Legal</div>", None, ["One"]),
    ("<div>Menu</div><p>Story</p><p>Same</p><div>End</div>", "<div>Menu</div><p>Tale</p><div>End</div>", ["Story", "Same"]),
    ("<article><p>One</p><p>Quoted</p><div class='share-line'>Tell us</div></article>", "<article><p>Quoted</p><div class='share-line'>Tell us</div></article>", ["One", "Quoted"]),
    ("<div class='cookie-notice'>ok?</div><div id='comments'><article>me</article></div><p>Text <button>no</button>on <span class=ad>no</span>it</p>", "<p>x</p>", ["Text on it"]),
    ("<body class='menu'><div class='banner'><article class='ad'><p>All there is</p><aside>no</aside></article></div>", "<p>x</p>", ["All there is"]),
    ("<article><h2 id='related'>Related work</h2><section id='cookies'><p>About cookies</p></section><div class='related'>no</div><footer>no</footer></article>", None, ["Related work", "About cookies"]),
]


@pytest.mark.parametrize(("page", "near", "text"), PAGES)
def test_text_of_pages(page, near, text):
    assert text_of(page, near) == text


def test_differencing_in_a_table(spark):
    head, foot = "<div>Site menu</div><div>More</div>", "<div>Imprint</div>"
    pages = [(k, f"http://h.example/news/{k // 3}/{k}", f"{head}<p>Story {k}</p><p>Common words</p>{foot}" if k % 2 else f"{head}<p>Story {k}</p>{foot}", k) for k in range(30)]
    pages += [(100, "http://h.example/about", f"{head}<article><p>Site menu</p><p>Us</p></article>{foot}", 0), (101, "http://alone.example/x", f"{head}<p>Alone</p>", 0)]
    pages += [(102, None, "<p>no url</p>", 0), (103, "http://h.example/none", None, 0), (None, "http://z.example/a", "<p>q</p>", 0), (7, "http://z.example/a", "<p>q</p><p>r</p>", 0)]
    found = extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string, rank int")).collect()
    assert len(found) == len(pages)
    text = {(r.page_id, r.url): r.text for r in found}
    for k in range(1, 29):
        got = text[k, f"http://h.example/news/{k // 3}/{k}"]
        assert f"Story {k}" in got and "menu" not in got and "Imprint" not in got
    assert text[100, "http://h.example/about"] == "Site menu\n\nUs"
    assert text[101, "http://alone.example/x"] == "Site menu\n\nMore\n\nAlone"
    assert text[102, None] == "no url" and text[103, "http://h.example/none"] == ""
    assert text[None, "http://z.example/a"] == "" and text[7, "http://z.example/a"] == "r"
    assert extract_text(spark.createDataFrame(pages, "page_id bigint, url string, html string, rank int").limit(0)).count() == 0


class Plain(HTMLParser):
    """The article's blocks as the standard library's parser sees them, for pages without oddities."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside = [""], False
        self.feed(re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", "", html))

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in ("p", "article", "h1", "h2", "h3", "li", "ul", "div", "table", "tr", "td"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.blocks.append("")
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        return "\n\n".join(" ".join(b.split()) for b in self.blocks if b.split())


def nearest_lines(rows):
    """For each (path, lines) of one host, in order, the lines of the neighbour; None: it has none."""
    rows = sorted(rows, key=lambda r: r[0].encode())
    for k, (path, lines) in enumerate(rows):
        near = [(len(os.path.commonprefix([path, o[0]])), -j, o[1]) for j, o in enumerate(rows) if abs(j - k) == 1 and o[1] != lines]
        yield path, lines, max(near)[2] if near else None


def common_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_table_against_brute_force(spark):
    """Pages without any mark but one class: differencing decides on all of their lines."""
    rng, hosts = random.Random(5), {}
    for k in range(240):
        host, path = f"h{k % 7 if k % 3 else 0}.example", f"/{rng.choice('abc')}/{rng.randrange(9)}/{k}"
        lines = [rng.choice(["Menu", "More", "Imprint", "Terms", f"Line {rng.randrange(400)}", f"{host} says"]) for _ in range(rng.randint(0, 14))]
        hosts.setdefault(host, []).append((path, lines if k % 9 else ["Menu", "Copy", "Imprint"]))
    data = [(k, f"https://{h}{p}", "".join(f"<div{' class=ad' if x == 'Terms' else ''}>{x}</div>" for x in lines), "x") for k, (h, p, lines) in enumerate((h, *r) for h, rows in hosts.items() for r in rows)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string, uid string").repartition(3)
    found = {r.url: r for r in extract_text(df).collect()}
    decided = 0
    for h, rows in hosts.items():
        for path, lines, near in nearest_lines(rows):
            r = found[f"https://{h}{path}"]
            assert r.shared == common_length(lines, near or [])
            text, rest = r.text.split("\n\n") if r.text else [], iter(lines)
            assert all(x in rest for x in text) and "Terms" not in text
            assert len(text) + r.by_markup + r.by_difference + r.by_both == len(lines)
            assert r.by_markup + r.by_both == lines.count("Terms") and r.by_difference + r.by_both == r.shared
            decided += r.by_difference
    assert decided > 300


def test_query(spark, sf_dir):
    """The whole table beside the texts by another parser, and its differences beside a brute force."""
    found = {r.page_id: r for r in op2_page_differencing(spark, sf_dir).collect()}
    pages, by_host = spark.read.parquet(f"{sf_dir}/pages.parquet").collect(), {}
    assert len(found) == len(pages)
    for r in pages:
        assert found[r.page_id].text == Plain(r.html).text() and found[r.page_id].n_chars == len(found[r.page_id].text)
        host, path = host_and_path(r.url)
        by_host.setdefault(host, []).append((path, [x for x, _ in html_text.lines_of(r.html)], r.page_id))
    counts = {r.page_id: r.shared for r in extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    compared = 0
    for rows in by_host.values():
        if len({p for p, *_ in rows}) < len(rows):
            continue  # which of equal paths comes first is by hash
        ids = {p: i for p, _, i in rows}
        for path, lines, near in nearest_lines([r[:2] for r in rows]):
            assert counts[ids[path]] == common_length(lines, near or [])
            compared += near is not None
    assert compared
