"""Main text of web pages by consensus of their host.

A page's elements are containers, named by their generalised path: the tags and classes from the root, with digits and
long hexadecimal parts of classes folded. Each page scores its containers by the text they hold outside links and outside
boilerplate, in paragraphs above all, and casts its vote for the best few. Votes add up by host and path in Spark; a host's
winning path is the one with the largest sum. Each page is then extracted anew with the winner of its host; a page that
lacks the winner uses its own best container.

Names of classes alone lose no article: an element named like boilerplate is left out of the containers around it, but stays a
container with a low score, so what it wraps is still found. A name that says boilerplate only in part (notice-period) is left out only where most of
its text is links, or where the host's pages show that it recurs with the same text: elements with such names are counted by host, path and text
beside the votes. Lists of comments are known by their names' beginnings, or by having articles or list items with an author or a time each. A form is left out only where it
holds less than half of the page's text, and a header (by tag or name) only outside articles. Parsing takes time and memory in proportion to the page: elements point to their
parents, their text is a stretch of one list, and paths are chained hashes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import slices
from .storage import replaced, stored

VOTES = 3
BROADCAST_HOSTS = 200_000
#: How much the score of text within an element named like boilerplate counts.
NAMED_BOILERPLATE = 0.1
# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea title".split())
DROPPED = frozenset("nav header footer aside button select menu dialog head".split()) | RAW
CONTAINERS = frozenset("html body main article section form div td table tr tbody ul ol blockquote center".split())
PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li".split())
# Words of classes, ids and roles that mark boilerplate.
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo promoted promotion related replies respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo alert modal login search".split())
COMMENTS = frozenset("comment comments replies respond disqus".split())
#: Words that say where or what kind of box it is, not what is in it.
NEUTRAL = frozenset("site page main global primary secondary top bottom left right inner outer sticky fixed floating wrapper wrap container box block list item items section area bar col column row content slot unit zone group panel links link buttons button icons icon bottom mobile desktop post posts article articles story stories signup form inline media js id new my the".split())
#: Elements of a list that say who wrote an entry, and when.
ENTRY_MARKS = frozenset("author user username byline date time timestamp reply avatar".split())
#: Pages of a host from which an element's text can be said to recur there.
LEAST_PAGES = 3
#: A name that begins so says what stands beside the element's text, as in has-sidebar.
BESIDE = frozenset("has with no without is".split())
CONTENT = frozenset("article body content entry main post story text".split())

#: For tags whose end may be left out: the open elements that end where they begin, and those that such an end does not pass.
_ENDS = {
    "p": (("p",), tuple(CONTAINERS)),
    "li": (("li",), ("ul", "ol")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ()),
}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=[ \t\r\n\f]*([\"'])")
_RAW_END = {t: re.compile(rf"</{t}(?:[\s/][^>]*)?>", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_FOLD = re.compile(r"[0-9a-f]{6,}|\d+", re.I)
_PART = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")


@dataclass
class Page:
    """A page's elements in the order of their opening tags, each a place in these lists; 0 is the page itself, its own parent."""

    tag: list[str] = field(default_factory=lambda: [""])
    name: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    key: list[int] = field(default_factory=lambda: [0])  # hash of the generalised path
    depth: list[int] = field(default_factory=lambda: [0])
    dropped: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])  # named like boilerplate, or a form
    partly: list[bool] = field(default_factory=lambda: [False])  # a name that says boilerplate in part
    entry: list[bool] = field(default_factory=lambda: [False])  # names an author or a time, or is a time
    n_linked: list[int] = field(default_factory=list)  # its text in links
    linked: list[bool] = field(default_factory=lambda: [False])
    paragraph: list[bool] = field(default_factory=lambda: [False])
    article: list[bool] = field(default_factory=lambda: [False])  # inside an article or main element
    first: list[int] = field(default_factory=lambda: [0])  # its text: pieces[first:last]
    last: list[int] = field(default_factory=lambda: [0])
    pieces: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)  # each piece's innermost element
    n_text: list[int] = field(default_factory=list)
    worth: list[float] = field(default_factory=list)  # text outside links, that of paragraphs twice
    outer: list[int] = field(default_factory=list)  # the innermost boilerplate element around (or the element itself); 0 where there is none

    def path(self, i: int) -> str:
        """The generalised path's last names and the hash of all of them."""
        names, at = [], i
        while at and len(names) < 6:
            if self.tag[at] not in INLINE:
                names.append(self.name[at][:40])
            at = self.parent[at]
        return f"{'>'.join(reversed(names))}#{self.key[i]:016x}"


@lru_cache(4096)
def _named(tag: str, attributes: str, article: bool) -> tuple[str, bool, bool, bool, bool]:
    """(name, whether it is named like boilerplate, or in part, whether it is hidden, whether it names an author or a time)."""
    kind, boilerplate, partly, hidden, entry = "", False, False, False, tag == "time"
    wanted = COMMENTS if tag in ("article", "main") else () if tag in ("html", "body") else BOILERPLATE - {"header", "masthead"} if article or tag == "header" else BOILERPLATE
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif key in ("class", "id", "role"):
            tokens = value.split()
            for words in map(_PART.findall, tokens):
                entry |= not ENTRY_MARKS.isdisjoint(words)
                if not words or words[0] in BESIDE or words[0] in CONTENT and words[1:] == ["header"]:
                    continue
                of_comments = bool(wanted) and any(w in COMMENTS or w.startswith(("commentlist", "commentsection", "commentarea", "commentthread")) for w in words)
                if of_comments or any(w in wanted for w in words) and all(w in wanted or w in NEUTRAL for w in words):
                    boilerplate = True
                else:
                    partly |= any(w in wanted for w in words)
            if key == "class":
                kind = ".".join(sorted({_FOLD.sub("#", x) for x in tokens}))
    return f"{tag}.{kind}" if kind else tag, boilerplate, partly, hidden, entry


def parse(page: str | None, recurring: frozenset[int] = frozenset()) -> Page:
    """The elements of a page, with their text (none of dropped elements) and its measures; recurring: hashes of paths whose elements, named boilerplate in part, recur on the host."""
    page, out = page or "", Page()
    stack, opened = [0], {}  # places of open elements, and where in the stack those of each tag are
    n, last_end, broken, unclosed = len(page), page.rfind(">"), False, set()

    def put(text: str) -> None:
        if not out.dropped[stack[-1]]:
            out.pieces.append(text)
            out.at.append(stack[-1])

    def close(to: int) -> None:
        for i in reversed(stack[to:]):
            out.last[i] = len(out.pieces)
            opened[out.tag[i]].pop()
        del stack[to:]

    def top(tags: tuple[str, ...]) -> int:
        return max((o[-1] for t in tags if (o := opened.get(t))), default=0)

    at = 0
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            put(html.unescape(page[at : lt if lt >= 0 else n]))
            if lt < 0:
                break
        m = _NAME.match(page, lt)
        if not m:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
            elif page.startswith(("<!", "<?"), lt) and lt < last_end:
                at = page.find(">", lt) + 1
            else:
                put("<")
                at = lt + 1
            continue
        if lt > last_end:
            break  # a tag that the page's end cuts off
        # Quoted values may hold ">"; from the first one on that never ends, tags end at the next ">".
        end = look = m.end()
        while not broken:
            stop = _STOP.search(page, look)
            if stop and not stop[1]:
                end = stop.start()
                break
            look = page.find(stop[1], stop.end()) + 1 if stop else 0
            broken = look == 0
        if broken:
            end = page.find(">", m.end())
        tag, attributes = m[2].lower(), page[m.end() : end]
        at, alone = end + 1, attributes.endswith("/")
        if m[1]:
            if opened.get(tag):
                close(opened[tag][-1])  # an inline element left open ends with the block around it
            if tag not in INLINE:
                put(" ")
            continue
        if tag in RAW:
            if not alone and tag not in unclosed:
                found = _RAW_END[tag].search(page, at)
                if found:
                    at = found.end()
                elif tag in ("script", "style"):
                    break
                else:
                    unclosed.add(tag)
            continue
        if tag not in INLINE:
            put(" ")
        if tag in VOID or alone and tag not in CONTAINERS:
            continue
        if tag in _ENDS:
            ends, bounds = _ENDS[tag]
            if (to := top(ends)) and to > top(bounds):
                close(to)
        up, i = stack[-1], len(out.tag)
        name, named, partly, hidden, entry = _named(tag, attributes, out.article[up]) if attributes else (tag, False, False, False, tag == "time")
        inline, article = tag in INLINE, out.article[up] or tag in ("article", "main")
        out.tag.append(tag)
        out.name.append(name)
        out.parent.append(up)
        out.key.append(out.key[up] if inline else xxhash.xxh64_intdigest(f"{out.key[up]:x}>{name}"))
        out.depth.append(out.depth[up] + (not inline))
        out.dropped.append(out.dropped[up] or hidden or tag in DROPPED and not (tag == "header" and article))
        out.named.append(named or tag == "form")
        out.partly.append(partly and not named)
        out.entry.append(entry)
        out.linked.append(out.linked[up] or tag == "a")
        out.paragraph.append(out.paragraph[up] or tag in PARAGRAPHS)
        out.article.append(article)
        out.first.append(len(out.pieces))
        out.last.append(0)
        opened.setdefault(tag, []).append(len(stack))
        stack.append(i)
    close(1)
    out.last[0] = len(out.pieces)
    _measure(out, recurring)
    return out


def _entries(page: Page) -> set[int]:
    """Lists outside articles all of whose entries, two at least, name an author or a time."""
    found: dict[int, list[bool]] = {}
    marked = list(page.entry)
    for i in range(len(page.tag) - 1, 0, -1):
        up = page.parent[i]
        if page.tag[i] == "li" and page.tag[up] in ("ol", "ul") and not page.article[i]:
            found.setdefault(up, []).append(marked[i])
        elif page.tag[i] not in ("li", "ol", "ul"):
            marked[up] |= marked[i]
    return {i for i, each in found.items() if len(each) > 1 and all(each)}


def _measure(page: Page, recurring: frozenset[int]) -> None:
    """Adds up text by element, inside out; an element that is boilerplate keeps its own from those around it."""
    n, entries = len(page.tag), _entries(page)
    page.n_text, page.n_linked, page.worth = [0] * n, [0] * n, [0.0] * n
    for text, i in zip(page.pieces, page.at, strict=True):
        if k := len(text.strip()):
            page.n_text[i] += k
            page.n_linked[i] += k * page.linked[i]
            page.worth[i] += k * (1 - 2 * page.linked[i] + page.paragraph[i])
    every = sum(page.n_text)
    boilerplate = [False] * n
    for i in range(n - 1, 0, -1):
        boilerplate[i] = page.named[i] and not (page.tag[i] == "form" and 2 * page.n_text[i] >= every) or page.partly[i] and (2 * page.n_linked[i] >= page.n_text[i] or page.key[i] in recurring) or i in entries and 2 * page.n_text[i] < every
        if not boilerplate[i]:
            page.n_text[page.parent[i]] += page.n_text[i]
            page.n_linked[page.parent[i]] += page.n_linked[i]
            page.worth[page.parent[i]] += page.worth[i]
    page.outer = [0] * n
    for i in range(1, n):
        page.outer[i] = i if boilerplate[i] else page.outer[page.parent[i]]


def _candidates(page: Page) -> Iterator[int]:
    """The page itself and its containers that have text of their own or of inner elements."""
    return (i for i, k in enumerate(page.n_text) if k and (not i or page.tag[i] in CONTAINERS) and not page.dropped[i])


def _score(page: Page, i: int) -> float:
    """What the text is worth, less for what lies far out or in boilerplate, more for names of content."""
    worth = page.worth[i] * (1 + 0.02 * min(page.depth[i], 20))
    if page.tag[i] in ("article", "main") or page.tag[i] not in ("html", "body") and not CONTENT.isdisjoint(_PART.findall(page.name[i])):
        worth *= 1.5
    return worth * NAMED_BOILERPLATE if page.outer[i] else worth


def _text(page: Page, chosen: list[int]) -> str:
    """The chosen containers' text in page order, less that of boilerplate within them."""
    out = []
    for i in chosen:
        s, e = page.first[i], page.last[i]
        kept = (x for x, at in zip(page.pieces[s:e], page.at[s:e], strict=True) if page.outer[at] <= i)
        if t := _BLANK.sub(" ", "".join(kept)).strip():
            out.append(t)
    return " ".join(out)


def partly_named(page: Page) -> list[tuple[str, int]]:
    """(path, hash of the text) of the elements whose names say boilerplate in part, and that have text of their own."""
    return [(f"!{page.key[i]:016x}", xxhash.xxh64_intdigest(_BLANK.sub(" ", "".join(page.pieces[page.first[i] : page.last[i]])).strip()) >> 1) for i in range(1, len(page.tag)) if page.partly[i] and page.n_text[i]]


def best(page: str | None | Page, n: int = VOTES) -> list[tuple[str, float]]:
    """(path, score) of the page's best containers, the best first."""
    parsed, scores = page if isinstance(page, Page) else parse(page), {}
    for i in _candidates(parsed):
        if (s := _score(parsed, i)) > scores.get(parsed.key[i], (0.0, 0))[0]:
            scores[parsed.key[i]] = (s, i)
    found = sorted(scores.values(), key=lambda x: (-x[0], parsed.key[x[1]]))[:n]
    return [(parsed.path(i), s) for s, i in found]


def extract(page: str | None, path: str | None, recurring: frozenset[int] = frozenset()) -> str:
    """The text of the page's containers at path, in page order; of its own best container where it has none there."""
    parsed = parse(page, recurring)
    found = list(_candidates(parsed))
    wanted = int(path.rpartition("#")[2], 16) if path else None
    chosen = [i for i in found if parsed.key[i] == wanted]
    if not chosen and found:
        chosen = [max(found, key=lambda i: (_score(parsed, i), parsed.key[i]))]
    return _text(parsed, chosen)


def host(url: str = "url") -> F.Column:
    """The host of a URL in lower case, without a port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, votes: int = VOTES) -> DataFrame:
    """(host, path, weight, recurring): the winning path of each host, and hashes of the paths whose elements, named boilerplate in part, have one text on at least half of
    the host's pages that have them (LEAST_PAGES or more). A page's votes are its best containers' shares of its best score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, 1)):
            out: dict[tuple[str, str, int | None], list[float]] = {}
            for h, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parsed = parse(page.as_py())
                found = best(parsed, votes)
                for path, s in found:
                    out.setdefault((h, path, None), [0.0, 0])[0] += round(s / found[0][1], 6)
                for path, text in set(partly_named(parsed)):
                    out.setdefault((h, path, text), [0.0, 0])[1] += 1
            hosts, paths, texts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(texts, pa.int64()), pa.array([round(x, 6) for x, _ in out.values()], pa.float64()), pa.array([n for _, n in out.values()], pa.int64())], names=["host", "path", "text", "weight", "n"])

    cast = pages.select(host().alias("host"), "html").mapInArrow(run, "host string, path string, text long, weight double, n long")
    sums = stored(cast.groupBy("host", "path", "text").agg(F.sum(F.col("weight").cast("decimal(30,6)")).alias("weight"), F.sum("n").alias("n")), "host-votes")
    winners = sums.where("text is null").groupBy("host").agg(F.max_by("path", F.struct("weight", "path")).alias("path"), F.max("weight").cast("double").alias("weight"))
    texts = sums.where("text is not null").groupBy("host", "path").agg(F.max("n").alias("same"), F.sum("n").alias("n")).where(f"n >= {LEAST_PAGES} and 2 * same >= n")
    recurring = texts.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("recurring"))  # a host's templates
    return winners.join(recurring, "host", "left")


def main_text(pages: DataFrame, votes: int = VOTES) -> DataFrame:
    """pages (url, html and other columns) without html, with text and n_chars (its code points).

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by one. Null
    or empty html, and pages that have no text outside dropped elements, give an empty text; a page without containers is its own. Pages
    without a host (null URLs too) share one ballot. Repeated rows vote and are extracted each; of paths with equal votes the
    larger one wins, of a page's containers with equal scores the one whose path has the larger hash. Long, deep and broken pages take time in
    proportion to their length. An empty table gives an empty result. Input columns named text or n_chars give way.
    """
    keep = [c for c in replaced(pages, "text", "n_chars", "__host", "__path", "__recurring") if c != "html"]
    paths = stored(host_paths(pages, votes).select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("recurring").alias("__recurring")), "host-paths")
    paths = F.broadcast(paths) if paths.count() <= BROADCAST_HOSTS else paths  # else a shuffled join, whose large partitions Spark splits
    met = pages.select(*keep, "html", host().alias("__host")).join(paths, "__host", "left").select(*keep, "html", "__path", "__recurring")
    out = T.StructType([*pages.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, at)):
            known = [frozenset(int(x[1:], 16) for x in some or ()) for some in b.column(at + 2).to_pylist()]
            texts = [extract(page.as_py(), path, some) for page, path, some in zip(b.column(at), b.column(at + 1).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in out.fields])

    return met.mapInArrow(run, out)
