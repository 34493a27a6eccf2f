import random
import re
import time

import pytest

from sitescore.llm import html_pagediff as hp
from sitescore.llm import warc_source as ws


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    return best[-1][-1]


@pytest.mark.parametrize("cells", [1 << 28, 4])
def test_alignment(monkeypatch, cells):
    monkeypatch.setattr(hp, "CELLS", cells)
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 15))] for _ in range(2))
        pairs = hp.common(a, b)
        assert len(pairs) == brute_lcs(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


HEAD = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">'


def text(html):
    return hp.main_text(hp.parse(html))[0]


@pytest.mark.parametrize(
    "body,want",
    [
        ("<nav><ul><li><a>Home</a></li></ul></nav><article><h1>T &amp; U</h1><p>a  b\n c<br>d<p>e &eacute;&#33;</article><footer>x</footer>", "T & U\na b c d\ne é!"),
        ("<header><h1>Site</h1></header><article><header><h1>T</h1><span>by me</span></header><p>x</p><section class=comments><p>c</p></section></article>", "T\nx"),
        ("<div class='content has-sidebar'><div class=sidebar>s</div><article><p>x</p><form>f</form><aside>a</aside></article></div>", "x"),
        ("<article><p>x &am</p><!-- <p>no</p> --><p hidden>h</p><div class=ad>a</div><p>y &lt;b&gt;</article>", "x &am\nh\ny <b>"),
        ("<main><div role=navigation>n</div><p>x</p><article><p>y</p></article></main>", "y"),
        ("<main><p>x</p><table><tr><td>1<td>2<tr><td>3</table></main>", "x\n1 2\n3"),
        ("<p>no article<p>here<div id=cookie-notice>c</div>", "no article\nhere"),
        ("<article><p><b>open<p>next</article><p>after", "open\nnext"),
        ("<article><p>x</p><ins class=adsbygoogle>a</ins><div id=siteFooter>f</div><ol class='comment-list'><li>c</ol><p>y</article>", "x\ny"),
        ("", ""),
        ("<article><p class=legal-analysis>a<div class=share-price>b</div><h2 class=section-header>c</h2><p id=search-results>d<p class=alert-level>e</article>", "a\nb\nc\nd\ne"),
        ("<main><p>the long text of the page<article class=teaser><p>teaser</article></main>", "the long text of the page\nteaser"),
        ("<article><p>" + "İ" * 40 + "</p><script>a()</SCRIPT ><p>two three</p><p>eight</p></article>", "İ" * 40 + "\ntwo three\neight"),
        ("<article><p>a <math><mi>x</mi></math> <svg><text>s</text></svg><noscript>n</noscript></p><select><option>o</select><button>b</button></article>", "a x sn"),
        ("<article><span role=alert>no <span>no</span> no</span><p>a<title>t</title></p></article>", "a"),
        ('<article><p title="a > b">x</p><p title=">y</p><p>z</p></article>', "x\ny\nz"),
        ("<article><p>text</p></article><section id=comments><article>a comment that is longer than the text</article></section>", "text"),
        ("<article><p>text</p><div class=comments><main><article>a comment</article></main></div><p>end</p></article>", "text\nend"),
        ("<article><p>text</p></article><article class=comment>a comment that is longer than the text</article>", "text"),
        ("<article><p>text</p><div class=reader-comments>c</div><div class='share-buttons'>s</div><div class=related>r</div><div class=subscribe-box>s</div><div class=user-reviews>u</div></article>", "text"),
        ("<div class=promo-box><article>in a promo box</article></div>", "in a promo box"),
        ("<article><p>x < y</p><![CDATA[c & d]]><![CDATA[e<?php f ?><!x></ ></article><p>after <a href='x", "x < y\nc & d"),
    ],
)
def test_main_text(body, want):
    assert text(HEAD + body) == want


def test_shared_lines_go(spark):
    """Without markup that tells, template lines go because neighbours share them."""
    page = lambda i: f"<div>Menu</div><div>Today in the Herald</div><div>story {i} begins</div><div>and number {i} ends</div><div>All rights {i // 100}</div>"
    rows = [(i, f"http://h.org/a/{i:03d}", page(i)) for i in range(30)]
    rows += [(100, "http://h.org/a/100x", "<article><p>Menu</p><p>own</p></article>"), (101, "http://other.org/1", page(1))]
    got = {r["page_id"]: r["text"] for r in hp.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(30)] == [f"story {i} begins\nand number {i} ends" for i in range(30)]
    assert got[100] == "Menu\nown"
    assert got[101].startswith("Menu\n")  # the only page of its host


UNCLOSED = ["<a b ", '<a b="', "<a 'x\" ", "<![CDATA[", "<!-- ", "<title>", "<textarea x>", "<div><b>", "<li><ul><div>", "</b>", "<p><table>", "<span role=alert>", "<a b='\">", "<"]


@pytest.mark.parametrize("end", ["", ">", "'>", '"'])
@pytest.mark.parametrize("piece", UNCLOSED)
def test_malformed_pages_take_linear_time(piece, end):
    began = time.process_time()
    hp.parse("<article><p>x</p>" + piece * (1_000_000 // len(piece)) + end)
    assert time.process_time() - began < 4


def brute_extract(rows):
    """Every page against the two before and the two after it in the order of the whole table."""
    key = lambda r: (re.match(r"https?://([^/]*)(.*)", r[1]).groups(), r[0])
    rows = sorted(rows, key=key)
    host = lambda r: key(r)[0][0]
    out = {}
    for i, r in enumerate(rows):
        me = hp.parse(r[2])
        near = [hp.parse(rows[j][2]) for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(rows) and host(rows[j]) == host(r)]
        told = []
        for other in near:
            if other.lines != me.lines and me.lines and other.lines:
                pairs = hp.common(me.lines, other.lines)
                assert len(pairs) == brute_lcs(me.lines, other.lines)
                share = sum(len(me.lines[a]) for a, _ in pairs) / min(sum(map(len, me.lines)), sum(map(len, other.lines)))
                told.append(({a for a, _ in pairs}, share))
        if any(s <= hp.COPY for _, s in told):
            told = [x for x in told if x[1] <= hp.COPY]
        need = min(2, len(told))
        keep = lambda k: me.inside[k] or (not me.article and (not need or sum(k in x for x, _ in told) < need))  # noqa: E731, B023
        out[r[0]] = "\n".join(x for k, x in enumerate(me.lines) if keep(k))
    return out


@pytest.mark.parametrize("partitions", [1, 8, 60, 200])
def test_result_ignores_partitions(spark, partitions):
    """60 template pages without an article, and some with, in two hosts; with more ranges than pages too."""
    rng = random.Random(9)
    menu = [f"menu line {i}" for i in range(12)]
    page = lambda i: "".join(f"<div>{x}</div>" for x in [*menu[: rng.randint(8, 12)], *(f"text {i} {rng.randint(0, 3)}" for _ in range(rng.randint(1, 4))), "All rights"])
    rows = [(i, f"http://{'ab'[i % 2]}.org/p/{rng.randint(0, 30):02d}", page(i)) for i in range(60)]
    rows += [(100 + i, f"http://a.org/p/{i:02d}", f"<nav>n</nav><article><p>menu line 1</p><p>{i}</p></article>") for i in range(0, 20, 3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = hp.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
        assert {r["page_id"]: r["text"] for r in found.collect()} == brute_extract(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_short_text_under_a_long_menu(spark):
    menu = "".join(f"<div>a long line {i} of the menu of this host</div>" for i in range(40))
    rows = [(i, f"http://h.org/{i}", f"{menu}<div>own {i}</div>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in hp.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own {i}" for i in range(6)}


def test_rows_of_one_url_and_id_spread(spark):
    rows = [(7, "http://h.org/same", f"<article><p>text {i}</p></article>") for i in range(400)]
    found = hp.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8))
    assert sorted(r["text"] for r in found.collect()) == sorted(f"text {i}" for i in range(400))


def test_copies_do_not_delete_each_other(spark):
    rows = [(i, f"http://h.org/{i}", "<div>same text</div><div>in all of them</div>") for i in range(5)]
    got = {r["text"] for r in hp.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"same text\nin all of them"}


BIG = "payload é " * 150


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"fileBytes": "3000"}])
def test_warc_round_trip(spark, options):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2\r\nX-Evil: 1", BIG), (3, None, BIG), (None, "http://a/4", BIG), (5, "http://a/5", "small"), (6, "http://a/6", "small"), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]
    got = ws.archived(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()
    by = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got}
    n = len(BIG.encode())
    assert by == {1: (n, "revisit", 3), 2: (n, "revisit", 3), 3: (n, "response", None), None: (n, "revisit", 3), 5: (5, "response", None), 6: (5, "response", None), 7: (2800, "response", None)}
    import hashlib

    assert {r["payload_digest"] for r in got if r["payload_bytes"] == n} == {hashlib.sha1(BIG.encode()).hexdigest()}


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_pushed_filters_skip_payloads(spark, tmp_path, monkeypatch, compression):
    rows = [(i, f"http://a/{i}", f"page {i} " * 500) for i in range(8)] + [(20 + i, "http://b/x", "copy " * 400) for i in range(3)]
    path = str(tmp_path / "w")
    ws.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path, compression=compression)
    found = ws.read_records(spark, path)
    assert {r["page_id"] for r in found.where("record_type = 'revisit'").collect()} == {20, 21}
    assert [r["payload"].decode() for r in found.where("target_uri = 'http://a/3'").select("payload").collect()] == ["page 3 " * 500]
    assert found.where("page_id in (1, 2)").count() == 2
    few = ws.read_records(spark, path, "page_id long, payload_bytes long")
    assert {r["page_id"]: r["payload_bytes"] for r in few.collect()} == {r[0]: len(r[2]) for r in rows}
    # The reader itself: blocks are read only for the records that pass.
    seen = []
    block = ws.Records.block
    monkeypatch.setattr(ws.Records, "block", lambda self, n: seen.append(n) or block(self, n))
    from pyspark.sql.datasource import EqualTo
    from pyspark.sql.types import _parse_datatype_string

    reader = ws.WarcReader(_parse_datatype_string(ws.SCHEMA), {"path": path})
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload_bytes",), 3)])) == [EqualTo(("payload_bytes",), 3)]
    assert sum(b.num_rows for f in reader.partitions() for b in reader.read(f)) == 2 and len(seen) == 2
