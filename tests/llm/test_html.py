"""Main text: what classes, forms, headers and broken tags must not lose, and pages that are deep, long or broken."""

import time

import pytest

from cubeloom.llm import html_extraction
from cubeloom.llm.html_extraction import best, extract


def main(page):
    found = best(page)
    return extract(page, found[0][0] if found else None)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p>A</p><svg class="i"/><p>B</p>', "A B"),
        ('<p>A</p><iframe src="x"/><p>B</p>', "A B"),
        ("<p>A</p><iframe src='x'><p>B</p>", "A B"),
        ("<p>A</p><svg><text>no</text></svg><p>B</p>", "A B"),
        ('<body><script src="x"/><p>A</p></body>', "A"),
        ("<p>A</p><script>if (1 < 2) { no }", "A"),
        ('<body><form id="aspnetForm"><nav>no</nav><p>all of the text</p></form></body>', "all of the text"),
        ("<body><article><p>a long enough article</p><form>Your name</form></article></body>", "a long enough article"),
        ('<div class="layout has-sidebar"><article><p>story</p></article><div class="sidebar">no</div></div>', "story"),
        ('<article><div class="no-sidebar"><p>story</p></div><div class="sidebar">no</div></article>', "story"),
        ('<body><div class="comment-count-wrapper"><article><p>story</p></article></div></body>', "story"),
        ('<body><div class="comment-count-wrapper"><p>story</p></div></body>', "story"),
        ("<body><header>site</header><article><header><h1>Title</h1></header><p>text</p><footer>no</footer></article></body>", "Title text"),
        ('<body><article><header class="entry-header"><h1>Title</h1></header><p>text</p></article></body>', "Title text"),
        ('<body><article><p>story of some length</p></article><div id="comments"><article class="comment"><p>no</p></article></div></body>', "story of some length"),
        ('<p title="hidden gem">yes</p><p hidden>no</p>', "yes"),
        ('<p>A <a href="x>B</a></p><p>C</p>', "A B C"),
        ("<p title=don't>A</p><p>it's B</p>", "A it's B"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<td>e<tr><td>f</table>", "a b c d e f"),
        ("<p>a < b &amp; c<br>d</p>", "a < b & c d"),
        ("<p>cut <b", "cut"),
        ("", ""),
        (None, ""),
    ],
)
def test_text_that_stays_and_goes(page, text):
    assert main(page) == text


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x", "<div class='a b'>" * 50_000 + "x", "<span>" * 30_000 + "<li>x" * 30_000, '<a b="' * 40_000, '<a ">" ' * 40_000, "<a b='" + '<a b = "' * 40_000, "<" * 100_000, "<svg>" * 50_000, "</p>" * 100_000, "<p>x" * 50_000, "x " * 1_000_000],
)
def test_deep_and_broken_pages_take_linear_time(page):
    began = time.process_time()
    html_extraction.parse(page)
    assert time.process_time() - began < 3


def test_ties_and_a_shuffled_join(spark, monkeypatch):
    two = "<body><div class='a'><p>one two</p></div><div class='b'><p>six ten</p></div></body>"
    rows = [(i, f"http://h{i % 3}.example/{i}", two if i % 2 else f"<body><article><p>number {i}</p></article></body>") for i in range(12)]
    df = spark.createDataFrame([*rows, rows[1], (None, None, two)], "page_id long, url string, html string")
    out = html_extraction.main_text(df).collect()
    assert len(out) == 14 and out.count(next(r for r in out if r["page_id"] == 1)) == 2
    monkeypatch.setattr(html_extraction, "BROADCAST_HOSTS", 0)
    key = lambda r: (r["page_id"] is None, r["page_id"] or 0, r["text"])
    assert sorted(html_extraction.main_text(df).collect(), key=key) == sorted(out, key=key)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><div class="page-header"><h1>TITLE</h1></div><p>story of some length</p></article>', "TITLE story of some length"),
        ('<article><p>story of some length</p><div class="social-history"><p>never smoked</p></div></article>', "story of some length never smoked"),
        ('<article><p>story of some length</p><div class="notice-period"><p>three months</p></div></article>', "story of some length three months"),
        ('<div class="main"><article><p>story of some length</p></article><ol class="commentlist"><li>no</li></ol></div>', "story of some length"),
        ('<div class="main"><p>story of some length</p><p>and more of it</p><ul><li><span class="author">A</span> no<li><time>1</time> no</ul></div>', "story of some length and more of it"),
        ('<div class="main"><p>story</p><ul><li>first point<li>second <b class="author">by A</b></ul></div>', "story first point second by A"),
        ('<article><p>story of some length</p><div class="related-reading"><a href="x">one more</a></div></article>', "story of some length"),
        ('<div><div class="page-header"><p>site</p></div><article><p>story of some length</p></article></div>', "story of some length"),
        ('<article><p>story of some length</p><div class="ad-slot"><p>buy</p></div><div class="post-footer">no</div></article>', "story of some length"),
    ],
)
def test_names_that_say_boilerplate_in_part(page, text):
    assert main(page) == text


def test_what_recurs_on_a_host_goes(spark):
    """One box stands on every page of a host with the same text, another with a text of each page; elsewhere nothing is known of either."""
    page = lambda i, same: f'<body><article><p>number {i} has a story</p><div class="newsletter-mailing"><p>{"join us today" if same else f"letter {i}"}</p></div></article></body>'
    rows = [(i, f"http://same.example/{i}", page(i, True)) for i in range(5)] + [(i, f"http://own.example/{i}", page(i, False)) for i in range(5, 10)]
    rows += [(i, f"http://few.example/{i}", page(i, True)) for i in range(10, 12)]
    got = {r["page_id"]: r["text"] for r in html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for i in range(5):
        assert got[i] == f"number {i} has a story"
    for i in range(5, 10):
        assert got[i] == f"number {i} has a story letter {i}"
    for i in range(10, 12):
        assert got[i] == f"number {i} has a story join us today"


def test_votes_are_those_of_a_plain_count(spark):
    """Hosts' winners by counting whole pages in one place, on pages without articles."""
    from collections import defaultdict
    from decimal import Decimal

    kinds = ["<div class='a'><p>one two three</p></div><div class='b'><p>six ten</p></div>", "<div class='b'><p>six ten and some more words</p></div><ul><li>x</ul>", "<table><tr><td>cells of text</td></tr></table>", "<p>no box</p>"]
    rows = [(i, f"http://h{i % 4}.example/", f"<body>{kinds[(i * 7 + i // 5) % 4]}</body>") for i in range(60)]
    sums = defaultdict(Decimal)
    for _, url, page in rows:
        found = best(page)
        for path, s in found:
            sums[url[7:-1], path] += round(Decimal(s / found[0][1]), 6)
    winners = {h: max(((w, p) for (g, p), w in sums.items() if g == h))[1] for h, _ in sums}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r["host"]: r["path"] for r in html_extraction.host_paths(df).collect()} == winners
    got = {r["page_id"]: r["text"] for r in html_extraction.main_text(df).collect()}
    assert got == {i: extract(page, winners[url[7:-1]]) for i, url, page in rows}
