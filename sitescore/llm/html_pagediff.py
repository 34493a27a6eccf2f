"""Main text of web pages by nearest-URL page differencing.

Pages are put in the order of host and URL path; a page is paired with its neighbours there. The
text lines (blocks) of a pair are aligned by a longest common subsequence, and what neighbours
share is template: shared lines are deleted. Two kinds of lines don't leave it to the neighbours:
elements whose kind is a menu, header, footer, form or aside go, and so do containers whose whole
name says advert, comments and the like; and lines inside an element that says it is the article
stay, since passages of articles repeat across pages as well.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Neighbours on each side.
NEIGHBOURS = 2
#: Pages that share so much of their text, beside neighbours that share less, are copies of each other,
#: which tell nothing about the template.
COPY = 0.8
#: Ranges of pages for each shuffle partition.
RANGES = 3
#: Cells of an alignment kept at once; larger ones are halved.
CELLS = 1 << 28

# Elements by their part in a page.
RAW = frozenset("script style textarea title iframe noframes noembed xmp".split())
PRUNED = frozenset("nav header footer aside form menu dialog select button template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold others; a name rules out these alone, no paragraph, heading or cell.
CONTAINERS = frozenset("div section ul ol dl ins table details figure center".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS = ("ul", "ol", "dl", "table")
SCOPE = ("table", "td", "th", "button", "article", "section", "main", "div")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ARTICLE_CLASSES = frozenset("article-body articlebody article-content post-content post-body entry-content story-body main-content articlecontent".split())
#: Words of class and id names that mark what isn't the article, if all other words of the name say no more than where or how large it is.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer header masthead topbar cookie cookies consent gdpr notice notices popup modal newsletter comment comments disqus pagination pager "
    "related share sharing social subscribe reviews".split()
)
COMMENTS = frozenset("comment comments disqus reviews".split())
NEUTRAL = frozenset("box bar block list item container wrapper wrap slot unit area section inner outer top bottom left right main site page global primary secondary sticky fixed module panel group thread form links widget policy cookie reader readers user users button buttons".split())

#: A tag whose quoted values may hold >; quotes without a second one are plain characters.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
ENDS = {x: re.compile(rf"</{x}(?![^\s/>])", re.I | re.A) for x in RAW}


@dataclass
class Page:
    """The lines of a page that markup doesn't rule out; inside tells those of the article; article, if there is one;
    shares has, for each neighbour that isn't an exact copy, the places of the lines that it shares and their part
    of the smaller page's text."""

    lines: list[str] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    article: bool = False
    shares: list[tuple[list[int], float]] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def named(value: str) -> str:
    """The word of MARKS of a class or id name that has one and else only words of NEUTRAL, or an empty text."""
    found = ""
    for x in map(str.lower, PARTS.findall(value)):
        whole = x in MARKS
        found = x if whole else found
        if not whole and x not in NEUTRAL and not x.isdigit():
            return ""
    return found


def marked(name: str, own: dict[str, str]) -> str:
    """What in an element's attributes says that it isn't the article, or an empty text."""
    if (role := own.get("role", "").strip().lower()) in ROLES:
        return role
    if name not in CONTAINERS and name != "article":
        return ""
    return next(filter(None, map(named, [*own.get("class", "").split(), own.get("id", "")])), "")


def article_like(name: str, own: dict[str, str]) -> int:
    """2 for an article, 1 for the main part of a page."""
    if name == "article" or own.get("itemprop", "").lower() == "articlebody" or ARTICLE_CLASSES & {*own.get("class", "").lower().split(), own.get("id", "").lower()}:
        return 2
    return int(name == "main" or own.get("role", "").lower() == "main")


class Tree:
    """The open elements: whether each rules its text out (1: but for headings, 2: but for an article, 3: all), and how
    much of an article it is. Where elements of a name are is kept beside, so that closing one needs no search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, closed: int, level: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, closed, level))

    def last(self, names) -> int:
        return max((x[-1] for n in names if (x := self.places.get(n))), default=0)

    def close(self, names, until=()) -> None:
        """End the innermost element of names, and all in it, unless one of until is further in."""
        at = self.last(names)
        if at and at > self.last(until):
            while len(self.stack) > at:
                self.places[self.stack.pop()[0]].pop()


def tokens(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, slash, name, attributes) of each stretch of text and the tag after it, in one pass: what was
    looked for in vain isn't looked for again. Comments and declarations have no name, the content of
    RAW elements isn't given."""
    at, n, start = 0, len(html), 0
    tag, missing = TAG, set()
    letter = lambda c: c.isascii() and c.isalpha()

    def ahead(what: str, place: int) -> int:
        found = -1 if what in missing else html.find(what, place)
        if found < 0:
            missing.add(what)
        return found

    while at < n:
        at = html.find("<", at)
        if at < 0 or at + 1 >= n:
            break
        c = html[at + 1]
        if html.startswith("<!--", at):
            end = ahead("-->", at + 4)
            yield html[start:at], "", "", ""
            start = at = n if end < 0 else end + 3
        elif html.startswith("<![CDATA[", at) and (end := ahead("]]>", at + 9)) >= 0:
            yield html[start:at] + html[at + 9 : end].replace("&", "&amp;"), "", "", ""
            start = at = end + 3
        elif c in "!?/" or letter(c):
            end = ahead(">", at + 1)
            if end < 0:  # a tag that doesn't end before the page does
                yield html[start:at], "", "", ""
                return
            if not letter(html[at + 2 : at + 3] if c == "/" else c):
                yield html[start:at], "", "", ""
                start = at = end + 1
                continue
            m = tag.match(html, at)
            if m is None:  # no tag ends outside quotes from here on
                tag = PLAIN_TAG
                m = tag.match(html, at)
            name = m[2].lower()
            yield html[start:at], m[1], name, m[3]
            start = at = m.end()
            if name in RAW and not m[1] and name not in missing:
                end = ENDS[name].search(html, at)
                if end:
                    start = at = end.start()
                elif name in ("script", "style"):
                    return
                else:
                    missing.add(name)
        else:
            at += 1
    yield html[start:], "", "", ""


def parse(html: str | None) -> Page:
    """Lines of a page in order: text between block boundaries, references decoded, white space made
    one space. Elements may be left open, as a browser allows. Of a header inside the article its
    headings count."""
    out: list[tuple[str, int]] = []
    tree = Tree()
    text: list[str] = []

    def flush() -> None:
        if text:
            line = " ".join(unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, tree.stack[-1][2]))

    for before, slash, name, rest in tokens(html or ""):
        if before and not tree.stack[-1][1]:
            text.append(before)
        if not name or name in RAW:
            continue
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th") and not tree.stack[-1][1]:
            text.append(" ")
        if slash:
            tree.close((name,))
            continue
        if name in VOID or rest.endswith("/"):
            continue
        if name in BLOCKS:
            tree.close(("p",), SCOPE)
        if name in CLOSED_BY:
            tree.close(CLOSED_BY[name], LISTS)
        own = attributes(rest)
        _, closed, level = tree.stack[-1]
        like = article_like(name, own)
        if name in HEADINGS and closed == 1:
            tree.push(name, 0, level)
            continue
        mark = "" if name in ("html", "body", "main") else marked(name, own)
        if mark in COMMENTS:
            closed, like = 3, 0  # for good: each comment may be an article
        elif name in PRUNED or mark and like < 2:
            closed = closed if closed == 3 else 1 if closed <= 1 and level and "header" in (mark, name) else 2
        elif like and closed == 2 and not tree.last(PRUNED):
            closed, level = 0, 0  # a container was ruled out by its name, yet it holds the article
        if name in BLOCKS or name in PRUNED or closed != tree.stack[-1][1] or like > level or name in ("td", "th") or tree.last((name,)):
            tree.push(name, closed, max(level, like))
    flush()
    best = max((x for _, x in out), default=0)
    size = [sum(len(line) for line, x in out if x == level) for level in (1, 2)]
    if size[0] > size[1]:  # of a main part with little in articles, these are teasers
        out, best = [(line, min(x, 1)) for line, x in out], 1
    return Page([x for x, _ in out], [best > 0 and x == best for _, x in out], best > 0)


def common(a: list, b: list) -> list[tuple[int, int]]:
    """The places (i, j) of a longest common subsequence, by bit vectors; long ones in halves."""
    there = {*a} & {*b}
    ia, ib = [i for i, x in enumerate(a) if x in there], [j for j, x in enumerate(b) if x in there]
    x, y = [a[i] for i in ia], [b[j] for j in ib]
    if len(x) * len(y) > CELLS and len(y) > 1:
        half = len(y) // 2
        before, after = lengths(x, y[:half]), lengths(x[::-1], y[half:][::-1])
        cut = max(range(len(x) + 1), key=lambda i: before[i] + after[len(x) - i])
        pairs = common(x[:cut], y[:half]) + [(i + cut, j + half) for i, j in common(x[cut:], y[half:])]
        return [(ia[i], ib[j]) for i, j in pairs]
    rows = list(vectors(x, y))
    out, i, j = [], len(x), len(y)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if not (j and not rows[j - 1] >> (i - 1) & 1):
            i -= 1
            out.append((ia[i], ib[j]))
    return out[::-1]


def vectors(x: list, y: list) -> Iterator[int]:
    """After each item of y: bit i is 0 where the common subsequence with x[: i + 1] is longer than with x[:i]."""
    places: dict = {}
    for i, v in enumerate(x):
        places[v] = places.get(v, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for v in y:
        both = row & places.get(v, 0)
        row = ((row + both) | (row - both)) & full
        yield row


def lengths(x: list, y: list) -> list[int]:
    row = (1 << len(x)) - 1
    for row in vectors(x, y):  # noqa: B007
        pass
    out = [0]
    for c in reversed(bin(row | 1 << len(x))[3:]):
        out.append(out[-1] + (c == "0"))
    return out


def compare(a: Page, b: Page) -> None:
    """Note on both pages which lines they share, if they aren't copies of each other."""
    if not a.lines or not b.lines or a.lines == b.lines:
        return
    pairs = common(a.lines, b.lines)
    share = sum(len(a.lines[i]) for i, _ in pairs) / min(sum(map(len, a.lines)), sum(map(len, b.lines)))
    a.shares.append(([i for i, _ in pairs], share))
    b.shares.append(([j for _, j in pairs], share))


def main_text(page: Page) -> tuple[str, int]:
    """The lines left, joined by \\n, and how many were deleted as shared.

    A line is template if two neighbours have it, or the one neighbour that there is. A neighbour that
    shares more than COPY of the text, where another shares less, is a near copy and tells nothing;
    where all share that much, a long template has little text in it. Lines inside the article stay.
    """
    told = page.shares
    if any(share <= COPY for _, share in told):
        told = [x for x in told if x[1] <= COPY]
    votes = [0] * len(page.lines)
    for places, _ in told:
        for i in places:
            votes[i] += 1
    need = min(2, len(told))
    template = [bool(need) and v >= need and not inside for v, inside in zip(votes, page.inside, strict=True)]
    kept = [x for x, t, inside in zip(page.lines, template, page.inside, strict=True) if not t and (inside or not page.article)]
    return "\n".join(kept), sum(template)


def host_and_path() -> tuple:
    """Columns of the host, in lower case and without port, and the path with query; null for a null URL."""
    rest = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#:]*)", 1))
    return host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1).alias("path")


def extract(pages: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row (page_id, url, text, n_template) for each row of pages(page_id, url, html, ...).

    Null and empty pages have an empty text; pages of any length are read whole, in time linear in
    their length. Pages are dealt out by ranges of (host, path, page_id), so a host of any size
    spreads over many tasks, and compared in that order as they stream by. The last pages of a range
    are also given to the ranges after it, and the first ones to those before it, so the result
    doesn't depend on where ranges end. Pages that tie in host, path and page_id are ordered by the
    hash of url and html. A page without a URL has no neighbours. Repeated rows come back as often as
    they came; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: deque = deque()
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "text", "n_template"])
            done.clear()
            return batch

        def leave(keep: int) -> None:
            while len(window) > keep:
                page_id, url, _, page, own = window.popleft()
                if own:
                    done.append((page_id, url, *main_text(page)))

        range_ = None
        for batch in batches:
            for row in range(batch.num_rows):
                part, page_id, url, host, html, own = (batch.column(i)[row].as_py() for i in range(6))
                page = parse(html)
                if window and (host is None or window[-1][2] != host or part != range_):
                    leave(0)
                range_ = part
                for other in window:
                    compare(other[3], page)
                window.append((page_id, url, host, page, own))
                leave(neighbours)
                if len(done) >= 500:
                    yield out()
        leave(0)
        yield out()

    order = ["host", "path", "page_id", "tie", "n"]
    rows = pages.select("page_id", "url", *host_and_path(), F.xxhash64("url", "html").alias("tie"), F.monotonically_increasing_id().alias("n"), "html")
    spans = ranges(rows.select(*order), order, neighbours)
    shared = pages.sparkSession.sparkContext.broadcast(spans)

    @F.pandas_udf("array<int>")
    def places(host: pd.Series, path: pd.Series, page_id: pd.Series, tie: pd.Series, n: pd.Series) -> pd.Series:
        firsts, lows, highs = shared.value
        out = []
        for key in zip(host, path, page_id, tie, n, strict=True):
            key = rank(key)
            own = max(0, bisect_right(firsts, key) - 1)
            near = [own]
            for step in (-1, 1):
                i = own + step
                while 0 <= i < len(firsts) and lows[i] <= key <= highs[i]:
                    near.append(i)
                    i += step
            out.append(near)
        return pd.Series(out)

    dealt = rows.select("page_id", "url", "html", *[c for c in order if c != "page_id"], F.posexplode(places(*order)).alias("context", "part"))
    dealt = dealt.repartition("part").sortWithinPartitions("part", *order)
    return dealt.select("part", "page_id", "url", "host", "html", (F.col("context") == 0).alias("own")).mapInArrow(run, "page_id long, url string, text string, n_template long")


def rank(key: tuple) -> tuple:
    """A key in Spark's order, nulls first."""
    return tuple((False, 0) if x is None or x is pd.NA or x != x else (True, x) for x in key)


def ranges(keys: DataFrame, order: list[str], neighbours: int) -> tuple[list, list, list]:
    """For each range of the keys its first one, and the first and the last of those that are inside it or
    within neighbours places of it. A few keys of each range come to the driver."""
    parts = RANGES * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    own = checkpoint(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", place))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    last = own.groupBy(part.alias("part")).agg(F.max(at).alias("last"))
    # last has a row for each range.
    ends = own.withColumn("part", part).join(F.broadcast(last), "part").where((at < neighbours) | (at > F.col("last") - neighbours))
    ends = ends.orderBy("place").collect()
    if not ends:
        return [], [], []
    found = [rank(tuple(r[c] for c in order)) for r in ends]
    begins = [i for i, r in enumerate(ends) if r["place"] & (1 << 33) - 1 == 0]
    finish = [*(i - 1 for i in begins[1:]), len(ends) - 1]
    return [found[i] for i in begins], [found[max(0, i - neighbours)] for i in begins], [found[min(len(ends) - 1, i + neighbours)] for i in finish]
