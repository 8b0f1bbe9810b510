"""Main text of pages: the alignment against a search without shortcuts, written pages, odd markup."""

import random
import re
from functools import cache
from html import unescape

import pytest
from cases import sentence
from pyspark.sql import functions as F

from lexispark.llm import html_extract as he

PAGES = "page_id long, url string, html string"


def best_match(a, b):
    """Size of the largest simple tree matching of two skeletons, by the recursive definition."""
    la, ca = he._children(a)
    lb, cb = he._children(b)

    @cache
    def size(i, j):
        if la[i] != lb[j]:
            return 0
        x, y = ca[i], cb[j]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(1, len(x) + 1):
            for q in range(1, len(y) + 1):
                best[p][q] = max(best[p - 1][q], best[p][q - 1], best[p - 1][q - 1] + size(x[p - 1], y[q - 1]))
        return 1 + best[-1][-1]

    return size(0, 0)


def skeleton(rng, n):
    lines, depth = ["0 #"], 0
    for _ in range(n):
        depth = rng.randint(1, depth + 1)
        lines.append(f"{depth} {rng.choice('abc')}")
    return "\n".join(lines)


@pytest.mark.parametrize("seed", range(25))
def test_alignment_is_a_largest_tree_matching(seed):
    rng = random.Random(seed)
    a, b = skeleton(rng, rng.randrange(1, 40)), skeleton(rng, rng.randrange(1, 40))
    partner = he.align(a, b)
    matched = [(i, j) for i, j in enumerate(partner) if j >= 0]
    assert len(matched) == best_match(a, b)
    la, ca = he._children(a)
    lb, cb = he._children(b)
    up_a, up_b = ({c: i for i, x in enumerate(children) for c in x} for children in (ca, cb))
    assert all(la[i] == lb[j] and (i == 0 or partner[up_a[i]] == up_b[j]) for i, j in matched)
    assert [j for _, j in matched] == sorted({j for _, j in matched})


def test_alignment_of_many_children():
    rng = random.Random(1)
    a = "0 #\n" + "\n".join(f"1 {rng.choice('abcdefgh')}" for _ in range(700))
    b = "0 #\n" + "\n".join(f"1 {rng.choice('abcdefgh')}" for _ in range(650))
    assert sum(j >= 0 for j in he.align(a, b)) == best_match(a, b)


def article(rng, i):
    return [sentence(rng, 30), f"Second &amp; last   paragraph\n of {i}: caf&eacute; &#8212; &lt;b&gt; done.", sentence(rng, 25)]


def page(parts, i):
    body = "".join(f"<p>{p}</p>" for p in parts)
    return f"""<!DOCTYPE html><html><head><title>Title {i}</title><style>p {{ color: red }}</style><script>var x = "<p>not text</p>";</script></head><body>
<header><h1>The site</h1></header><nav class="menu"><ul><li><a href="/">Home</a><li><a href="/b">Blog {i}</a></ul></nav>
<div class="cookie-notice">We use cookies {i}.</div><div id="wrap"><div class="content"><h2>Heading {i}</h2>{body}<div class="ad-box">Buy now {i}!</div></div>
<aside><p>Related {i}</p></aside><div class="comments"><p>Reader {i} says hello</p></div><form><label>Name</label><input name="x"><button>Send {i}</button></form></div>
<footer><p>Copyright {i}</p></footer></body></html>"""


def wanted(parts, i):
    return "\n\n".join([f"Heading {i}", parts[0], f"Second & last paragraph of {i}: café — <b> done.", parts[2]])


@pytest.fixture
def site():
    rng = random.Random(3)
    parts = [article(rng, i) for i in range(30)]
    return [(i, f"http://a.example.org/{i}", page(p, i)) for i, p in enumerate(parts)], [wanted(p, i) for i, p in enumerate(parts)]


def test_articles_without_the_rest(spark, site):
    rows, texts = site
    out = {r["page_id"]: r for r in he.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert [out[i]["text"] for i in range(len(rows))] == texts
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]][1] for r in out.values())


def test_template_without_telling_names_goes(spark):
    """Constant slots are template even where no tag or class says so."""
    rng = random.Random(4)
    rows = [(i, f"http://b.org/{i}", f"<body><div><p>Welcome to our site of many things</p></div><div><p>{sentence(rng, 40)}</p><p>{sentence(rng, 30)}</p></div><div><p>All rights reserved by us</p></div></body>") for i in range(20)]
    for r in he.extract(spark.createDataFrame(rows, PAGES)).collect():
        assert "Welcome" not in r["text"] and "rights" not in r["text"] and len(r["text"].split()) == 70


def test_varying_slots_without_telling_names_go(spark):
    """Menus, adverts and footers that differ on each page, and no name that says so: what is left out follows from counts over the host alone."""
    rng = random.Random(9)

    def varied(i):
        links = "".join(f'<li><a href="/{k}">{sentence(rng, 2)}</a></li>' for k in range(6))
        return f"<body><div><ul>{links}</ul></div><div class='x1'>{sentence(rng, 6)}</div><div class='x2'><h1>{sentence(rng, 5)}</h1><p>{texts[i][0]}</p><p>{texts[i][1]}</p><div><a href='/r'>{sentence(rng, 4)}</a></div></div><div class='x3'>site {i} {sentence(rng, 5)}</div></body>"

    texts = [(sentence(rng, 60), sentence(rng, 40)) for _ in range(24)]
    rows = [(i, "http://c.org/p", varied(i)) for i in range(24)]
    for hints in (True, False):
        for r in he.extract(spark.createDataFrame(rows, PAGES), hints=hints).collect():
            blocks = r["text"].split("\n\n")
            assert len(blocks) == 3 and tuple(blocks[1:]) == texts[r["page_id"]]


def test_two_layouts_of_one_host(spark):
    rng = random.Random(10)
    texts = [sentence(rng, 60) for _ in range(40)]
    one = lambda i: f"<body><div>{sentence(rng, 5)}</div><div class='b'><p>{texts[i]}</p></div><div>Always the same words</div></body>"
    two = lambda i: f"<body><table><tr><td class='m'>{sentence(rng, 5)}</td><td><p>{texts[i]}</p></td></tr></table><p>Other fixed words</p></body>"
    rows = [(i, "http://d.org/p", (one if i % 5 < 3 else two)(i)) for i in range(40)]
    out = {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame(rows, PAGES), hints=False).collect()}
    assert [out[i] for i in range(40)] == texts


def article_by_hand(html):
    """The article of the test pages by their own markup: headings and paragraphs in order."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)
    parts = re.split(r"</?(?:p|h1|div|ul|li|table|tr|blockquote)[^>]*>", inner[1]) if inner else []
    return "\n\n".join(t for t in (" ".join(unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"<!--.*?-->|<(?!br)[^>]*>", "", x, flags=re.S))).split()) for x in parts) if t)


def test_pages_of_the_table_by_counts_alone(spark, sf):
    """On the real pages wrappers exist, have template slots, decide what is left out, and give the article without any name or tag that says what it is."""
    table = spark.read.parquet(f"{sf}/../sf0.1/pages.parquet")
    host, _ = he.host_and_path(F.col("url"))
    known = he.wrappers(table.select("html", host.alias("host")), hints=False).collect()
    assert len(known) > 50 and sum(len(w["loose"]) for w in known) > 100
    html = {r["page_id"]: r["html"] for r in table.collect()}
    groups = {w["host"] for w in known}
    bare = {r["page_id"]: r["text"] for r in he.extract(table, hints=False).collect()}
    alone = {i: he.main_text(he.Page(h, False), None) for i, h in html.items()}
    wrapped = [r["page_id"] for r in table.select("page_id", host.alias("host")).collect() if r["host"] in groups]
    right = sum(bare[i] == article_by_hand(html[i]) for i in wrapped)
    assert right >= 0.98 * len(wrapped) and sum(bare[i] != alone[i] for i in wrapped) > 50
    named = {r["page_id"]: r["text"] for r in he.extract(table).collect()}
    assert sum(named[i] == article_by_hand(html[i]) for i in html) >= 0.99 * len(html)


def test_joined_wrappers_give_the_same(spark, site):
    rows, texts = site
    out = {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame(rows, PAGES), wrapper_bytes=0).collect()}
    assert [out[i] for i in range(len(rows))] == texts


ODD = {
    "": "", "plain words": "plain words", "<p>a  b</p>": "a b", "<p>open<p>another": "open\n\nanother", "<b>x</b>y": "xy", "<p>a<br>b</p>": "a b", "<div>1 &lt; 2 &unknown; &amp;amp;</div>": "1 < 2 &unknown; &amp;", "<p>cut <a href='x": "cut", "</p></div>text": "text", "<p>&#x1F600;&#0;</p>": "😀�",
    "<script>only()</script>": "", "<script>never closed": "", "<nav>menu</nav>": "", "<!-- note --><p>x</p>": "x", "<p>a<script>b</script>c</p>": "ac", "<table><tr><td>a<td>b<tr><td>c</table>": "a b\n\nc", "<P CLASS=Ad>no</P><P>yes</P>": "yes", "<div hidden>no</div><div>yes</div>": "yes", "<p>" + "<i>" * 3000 + "deep": "deep", "<div>" * 3000 + "deep": "deep", "<p>a <svg><g><title>t</title></g></svg>b</p>": "a b", "<p>a<div class=ad>x</div>b": "a\n\nb",
}


def test_odd_markup(spark):
    rows = [(i, None if i % 2 else f"http://h{i}.org/", h) for i, h in enumerate(ODD)] + [(900, None, None), (901, "no host", "<p>x</p>"), (None, "http://n.org", "<p>no id</p>"), (902, "http://same.org/", "<p>same</p>"), (902, "http://same.org/", "<p>same</p>")]
    out = he.extract(spark.createDataFrame([(*r, "own", "own") for r in rows], PAGES + ", text string, host string")).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    for i, h in enumerate(ODD):
        assert got[i] == ODD[h], h[:60]
    assert (got[900], got[901], got[None], got[902]) == ("", "x", "no id", "same")


def test_long_page(spark):
    rng = random.Random(5)
    parts = [sentence(rng, 20) for _ in range(3000)]
    html = "<body><nav>menu</nav><div>" + "".join(f"<p>{p}</p>" for p in parts) + "</div></body>"
    rows = [(i, "http://long.org/x", html.replace("menu", f"menu {i}")) for i in range(3)] + [(9, "http://long.org/y", "<body><nav>menu</nav><div><p>short text here</p></div></body>")]
    out = {r["page_id"]: r["text"] for r in he.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[0] == out[2] == "\n\n".join(parts) and out[9] == "short text here"


def test_empty_table(spark):
    assert he.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_query_on_the_table(spark, sf):
    from lexispark.llm.queries import QUERIES

    rows = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = QUERIES["op8_html_extraction"](spark, sf).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]]["url"] and "<script" not in r["text"] and r["text"] == r["text"].strip()
    assert sum(r["n_chars"] > 0 for r in out) > 0.9 * len(out)
