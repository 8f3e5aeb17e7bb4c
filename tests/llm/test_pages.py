"""Main text of pages: written pages with known text, malformed markup, and the given table."""

import html as entities
import re
import time
from collections import Counter

import pytest
from pyspark.sql import types as T

from textlytics.llm import html_extraction as hx
from textlytics.llm.catalog import QUERIES

LONG = "This is a paragraph of running text that goes on for long enough to be told from a menu by its ratio, number {}."
SITE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a = "</p><p>no</p>";</script></head><body class="has-sidebar">
<div class="site-header"><h1>Site name</h1></div><ul class="main-menu"><li><a href=/a>Home</a><li><a href=/b>News</a></ul>
<div id="cookieNotice"><p>We use cookies, and say so in a sentence that is as long as any other on this page, or even longer.</p></div>
{body}
<div class="comments"><p>I read all of it and liked it very much, so here is a comment of some length about it.</p></div>
<form action=/s><p>Write to us about anything at all, we like to read what you have to say about our pages.</p><input name=q></form>
<!-- <p>left out by its author</p> --><div class="footer"><p>Imprint and a longer sentence about who owns all of this and why.</p></div></body></html>"""

PAGES = [
    (SITE.format(body="<article class=post><header class=entry-header><h1>A title</h1><p>by me</p></header><p>{0}<p>Short.<ul><li>one<li>two</ul>"
                      "<blockquote>{1}</blockquote><div class=advert>Buy!</div><p>{2}</article>".format(*map(LONG.format, range(3)))),
     "A title\n{0}\nShort.\none\ntwo\n{1}\n{2}".format(*map(LONG.format, range(3)))),
    (SITE.format(body="<div class=wrap><div><a href=1>link</a> <a href=2>link</a></div><div class=text><p>{0}</p><p>Short.</p><p>{1}</p></div></div>"
                 .format(*map(LONG.format, range(2)))), "{0}\nShort.\n{1}".format(*map(LONG.format, range(2)))),
    ("", ""), (None, ""), ("no tags &amp; &#233;  at\nall", "no tags & é at all"), ("<nav>menu</nav>", ""), ("   \n", ""),
    ("<p>a<br>b&nbsp;&nbsp;c</p>", "a b c"), ("<p>1 < 2</p>&lt;p&gt;", "1 < 2\n<p>"), ("<p>a<!-- open <p>b", "a"), ("<p>t</p", "t"),
    ("<p>a</p><![foo[ x ]]><p>b<a href=\"x>c</p><p>d</p>", "a\nbc\nd"), ("<script>a<b</script>x", "x"), ("<head><title>a</title><p>b", "b"),
    ("<p>" + "word " * 300000 + "</p>", ("word " * 300000).strip()),
]


def test_pages_with_known_text():
    for page, want in PAGES:
        assert hx.main_text(page) == want, page and page[:200]


def test_malformed_pages_take_linear_time():
    began = time.time()
    for page in ("<!--" * 50000, "<a " * 50000, "<" * 50000, "<div>" * 50000 + "x", "<i><div>" + "<b>" * 50000 + "</i>" * 50000,
                 "<ul>" + "<li><span>" * 50000, "<nav>" * 50000, "<![CDATA[" * 50000, "</" * 50000, "<a x='>" * 50001):
        hx.main_text(page)
    assert time.time() - began < 60


def test_ratios_are_smoothed_and_split():
    flat = hx.smoothed([0.0, 0.0, 0.0, 100.0, 0.0, 0.0, 0.0])
    assert flat == flat[::-1] and flat[3] == max(flat) and flat[0] == 0 < flat[1] < flat[2]
    assert hx.threshold([50.0, 60.0, 70.0]) == 0 and hx.threshold([]) == 0 and hx.threshold([5.0]) == 0
    assert 3 < hx.threshold([1.0, 2.0, 3.0, 80.0, 90.0, 100.0]) < 80
    assert hx.names_skipped("x sideBar") and hx.names_skipped("page-footer") and hx.names_skipped("topnav") and hx.names_skipped("cookiebar")
    assert not hx.names_skipped("has-sidebar") and not hx.names_skipped("content loaded shadow adapter")


def test_table_of_awkward_pages(spark, tmp_path):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("_html", T.StringType())])
    rows = [(i, f"u{i}", h, "clash", "clash") for i, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], None, None)] * 2 + [(None, None, "<p>x", "", "")]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(map(tuple, QUERIES["op12_html_extraction"](spark, str(tmp_path)).collect()))
    texts = [t for _, t in PAGES] + [PAGES[0][1]] * 2 + ["x"]
    assert got == Counter((r[0], r[1], t, len(t)) for r, t in zip(rows, texts))
    none = hx.extracted(spark.createDataFrame([], schema))
    assert none.collect() == [] and none.columns == ["page_id", "url", "text", "n_chars"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_given_pages(spark, sf):
    """The given pages hold their text in an article of headings and paragraphs."""
    got = {r.page_id: r for r in QUERIES["op12_html_extraction"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " "))
        want = [" ".join(entities.unescape(re.sub(r"</?\w+>", "", b)).split()) for b in blocks]
        assert got[r.page_id].text == "\n".join(filter(None, want)) and got[r.page_id].n_chars == len(got[r.page_id].text)
