"""HTML extraction (operator 12): the main text of a page by text-to-tag ratios.

The standard library's parser streams over the page.  Its events cut the page into lines: a
line is what stands between two tags of block elements, with white space as one space.  Each line counts its
text (without that of links) and its tags; their ratio is high in running text and low in menus,
lists of links and captions.  Ratios are smoothed along the page with a Gaussian, so that a short
paragraph between long ones counts as text, and split into two clusters on a logarithmic scale
by the threshold between them; pages whose clusters lie close together have only one.

Lines are not selected one by one.  A region is an article, a main element, or outside those the innermost
sectioning element (section, div, table cell, ..) that holds a line; regions with a line of the upper
cluster are content, and so are those inside them that are not made of links.  Content regions keep every
line.  Articles, or else main elements, go before other regions if one of them is content; where no region
is, the one with most text is taken.

Elements that say what they are never get that far: ``SKIPPED`` elements and those whose role,
class or id names one of ``SKIPPED_NAMES`` (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments), hidden ones, scripts, styles and markup comments.  Their lines take part in the smoothing
as lines without text.  A header inside an article keeps its headings, and an article inside a form stays.

Defined cases: a null or empty page and one without main text give an empty text; text without any tag
is one line; unclosed and stray tags are taken as browsers take them, roughly: a block ends an open
paragraph, an end tag closes what was opened since its start tag, an unclosed comment goes to the end, a
tag that the page breaks off in is none; character references are decoded once;
repeated rows each get the same row; null ids and urls stay; an empty table gives no rows; columns
other than page_id, url and html are not read.  One page is in memory at a time, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlytics.llm.common import long_rows

#: standard deviation of the smoothing, in lines, and how many lines it looks to each side
SIGMA = 1.0
RADIUS = 2
#: clusters whose centres are closer than this factor are one
APART = 3.0

# --- fixed values: names of HTML elements and attributes ------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
SECTIONING = frozenset("html body article main section div center td th fieldset details figure".split())
SKIPPED = frozenset("head title script style noscript template nav header footer aside form button select option textarea input label "
                    "iframe object embed svg canvas audio video map menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: words of a role, class or id that name what is not main text
SKIPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promoted promotion promotions banner banners "
    "consent gdpr notice notices disclaimer alert popup modal overlay dialog newsletter subscribe subscription signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc skip toolbar topbar masthead "
    "header footer sidebar sidebars aside complementary contentinfo search searchbox form "
    "comment comments commentlist disqus respond replies reply related recommended recommendations share sharing social".split())
#: beginnings and ends of longer words that do so
SKIPPED_BEGINNINGS = ("cookie", "advert")
SKIPPED_ENDS = ("nav", "menu", "header", "footer", "sidebar", "comments")
#: a name after one of these says that something else has or has not got it
QUALIFIERS = frozenset("has have with without no non not hide is show".split())
#: elements that head may hold; any other one ends it
HEAD = frozenset("meta link base script style title noscript template basefont bgsound noframes".split())
#: start tags that end an open element of these names (an end tag that may be left out)
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
#: elements beyond which an omitted end tag is not looked for
SCOPE = frozenset("ul ol dl table article main section div body html".split())
# --------------------------------------------------------------------------------

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.S)
_MARKUP = re.compile(r"<[a-zA-Z/!?]")
#: open inline elements that an inline end tag looks through for its start tag
NESTED = 100
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def names_skipped(value: str) -> bool:
    """Whether a class, id or role names something that is not main text."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        for i, w in enumerate(words):
            if ((w in SKIPPED_NAMES or w.startswith(SKIPPED_BEGINNINGS) or w.endswith(SKIPPED_ENDS)
                 or i and words[i - 1] + w in SKIPPED_NAMES)  # side-bar
                    and not (i and words[i - 1] in QUALIFIERS)):
                return True
    return False


class Line:
    """A line of a page: its text, ratio, and the region that holds it."""

    __slots__ = ("text", "plain", "tags", "region", "rank")

    def __init__(self, text: str, plain: int, tags: int, region: int, rank: int):
        self.text, self.plain, self.tags, self.region, self.rank = text, plain, tags, region, rank

    @property
    def ratio(self) -> float:
        return self.plain / max(1, self.tags)


class Lines(HTMLParser):
    """Collects the lines of a page, fed as a whole, from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        #: open elements, each with the skipping that holds again after it (None: it did not change it)
        self.open: list[tuple[str, str | None]] = []
        self.count: Counter[str] = Counter()
        #: what is being skipped: "header", "form", "other" (also inside the former); empty: nothing
        self.skip = ""
        self.regions = [0]
        #: of each region, the number of the region around it; -1: the page or its body
        self.around = [-1]
        self.parts: list[str] = []
        self.plain = self.tags = 0

    # -------------------------------------------------------------- lines

    def line(self) -> None:
        """Ends the line that is being read."""
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            rank = 2 if self.count["article"] else 1 if self.count["main"] else 0
            self.lines.append(Line(text, min(self.plain, len(text)), self.tags, self.regions[-1], rank))
        self.parts, self.plain, self.tags = [], 0, 0

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)
            if not self.count["a"]:
                self.plain += len(data)

    # -------------------------------------------------------------- elements

    def _skips(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """What kind of skipped element this is; empty: none."""
        if tag in HEADINGS or tag in ("html", "body"):
            return ""
        if tag in SKIPPED:
            return tag if tag in ("header", "form") else "other"
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and _HIDDEN.search(value):
                return "other"
            if key in ("class", "id", "role") and value and names_skipped(value):
                # an article or the main element is left out only as somebody's comment
                if tag not in ("article", "main") or "comment" in value.lower():
                    return "header" if "header" in value.lower() else "other"
        return ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self._end_omitted(tag)
            self.line()
        elif self.count["head"] and self.open[-1][0] == "head":
            self._close(len(self.open) - 1)
        self.tags += 1
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        before = None
        if kind := self._skips(tag, attrs):
            before, self.skip = self.skip, "other" if self.skip else kind
        elif self.skip == "header" and tag in HEADINGS and self.count["article"] or self.skip == "form" and tag in ("article", "main"):
            before, self.skip = self.skip, ""  # an article's heading; a form around the whole page
        if tag in SECTIONING:
            if self.count["article"] or self.count["main"] and tag != "article":
                self.regions.append(self.regions[-1])  # an article is one region
            else:
                self.around.append(-1 if tag in ("html", "body") or self.open and self.open[-1][0] in ("html", "body") else self.regions[-1])
                self.regions.append(len(self.around) - 1)
        self.open.append((tag, before))
        self.count[tag] += 1

    def _end_omitted(self, tag: str) -> None:
        """Ends elements whose end tag was left out before this start tag."""
        if self.count["head"] and (tag == "body" or self.open[-1][0] == "head" and tag not in HEAD):
            self._close(next(i for i, x in enumerate(self.open) if x[0] == "head"))
        ended = ENDED_BY.get(tag, ())
        if not self.count["p"] and not any(self.count[x] for x in ended):
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == "p" or name in ended:
                self._close(i)
                if name != "p":
                    return
            elif name in SCOPE:
                return

    def _close(self, at: int) -> None:
        """Closes the open elements from number ``at`` on."""
        if any(name not in INLINE for name, _ in self.open[at:]):
            self.line()
        while len(self.open) > at:
            name, before = self.open.pop()
            self.count[name] -= 1
            if before is not None:
                self.skip = before
            if name in SECTIONING:
                self.regions.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:  # closes nothing beyond its block
            if tag == "br":
                self.handle_data(" ")
            if self.count[tag]:
                for i in range(len(self.open) - 1, max(-1, len(self.open) - 1 - NESTED), -1):
                    if self.open[i][0] == tag:
                        self.tags += 1
                        self._close(i)
                        return
                    if self.open[i][0] not in INLINE:
                        return
        elif self.count[tag]:
            at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag)
            self.tags += 1
            self._close(at)
        else:
            self.line()  # stray: still a border between lines

    # -------------------------------------------------------------- malformed markup
    # The parser waits for more input where markup is unfinished; here is none, so each ends as browsers end it.

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = _COMMENT.match(self.rawdata, i)
        return end.end() if end else len(self.rawdata)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, 0)

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        return end if end >= 0 else self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def read(self, html: str) -> tuple[list[Line], list[int]]:
        whole = html.rfind(">") + 1
        unfinished = _MARKUP.search(html, whole)  # a tag that the page breaks off in
        self.feed(html[:unfinished.start()] if unfinished else html)
        self.close()
        self.line()
        return self.lines, self.around


_KERNEL = [math.exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-RADIUS, RADIUS + 1)]


def smoothed(ratios: list[float]) -> list[float]:
    """The ratios along the page, each with its neighbours in a Gaussian; beyond the ends there is nothing."""
    total, n = sum(_KERNEL), len(ratios)
    padded = [0.0] * RADIUS + ratios + [0.0] * RADIUS
    return [sum(k * padded[i + j] for j, k in enumerate(_KERNEL)) / total for i in range(n)]


def threshold(values: list[float]) -> float:
    """Between the two clusters of the logarithms that leave least variance within; 0 if the
    clusters are not apart."""
    logs = sorted(math.log1p(v) for v in values)
    n, total = len(logs), sum(logs)
    best, cut, left = 0.0, 0.0, 0.0
    for i in range(1, n):
        left += logs[i - 1]
        if logs[i] == logs[i - 1]:
            continue
        low, high = left / i, (total - left) / (n - i)
        between = i * (n - i) * (high - low) ** 2
        if between > best:
            best, cut = between, (math.expm1((logs[i - 1] + logs[i]) / 2) if high - low > math.log(APART) else 0.0)
    return cut


def main_text(html: str | None) -> str:
    """The main text of a page: its content lines, joined by line breaks."""
    if not html:
        return ""
    lines, around = Lines().read(html)
    values = smoothed([x.ratio for x in lines])
    cut = threshold(values)
    content = {x.region: x.rank for x, v in zip(lines, values) if x.plain and v > cut}
    size, plain = Counter(), Counter()
    for x in lines:
        size[x.region] += len(x.text)
        plain[x.region] += x.plain
    if not content:
        size = +size
        content = {max(size, key=lambda r: (size[r], -r)): 0} if size else {}
    # what stands inside a content region and is not made of links belongs to it
    for region, outer in enumerate(around):  # a region comes after the one around it
        if outer in content and region not in content and 2 * plain[region] >= size[region]:
            content[region] = content[outer]
    rank = max(content.values(), default=0)
    return "\n".join(x.text for x in lines if x.text and content.get(x.region) == rank)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(id_col, url_col, F.col(html_col).alias("_html"))
    schema = T.StructType([rows.schema[id_col], rows.schema[url_col], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(url_col), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(long_rows(spark).read.parquet(f"{sf_dir}/pages.parquet"))
