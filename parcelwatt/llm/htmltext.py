"""Main text of web pages from flat text blocks and a decision tree.

A page is cut at block-level tags into text blocks; markup, scripts, styles and comments in the markup are left out and
character references decoded. Each block has its words and link density, those of the blocks before and after it, and what
the tags around it say of themselves (article, menu, advert, form, reader comments, ...). A decision tree trained on a small
table of labelled blocks keeps the blocks of the article, in page order.

The tree is trained when the operator is called and travels to the tasks; every page is read whole.

Defined results: a null or empty page, and one without article text, gives an empty text. Line breaks and table cells count as
white space inside a block. Pages are judged one by one, so repeated rows and null ids change nothing, an empty table gives no
rows and other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from parcelwatt.llm.common import text_chunks

# Tags of HTML by their use.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody textarea tfoot thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE_TAGS = frozenset("br td th img input".split())
UNREAD_TAGS = frozenset("head script style template noscript iframe object svg math canvas audio video title".split())
SIDE_TAGS = frozenset("nav footer aside form menu dialog button select option textarea fieldset legend label search".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
# Words of class and id names that tell what an element is for.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar rail menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert newsletter "
    "subscribe subscription signup login register social share sharing related recommended trending popular widget popup modal "
    "overlay pager pagination copyright legal disclaimer search tags taglist byline skip form paywall".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
MAIN_WORDS = frozenset("article content post entry story main".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

MAIN, SIDE, COMMENT, UNREAD, LINK, HEADING, HEADER, APART = 1, 2, 4, 8, 16, 32, 64, 128
# Tags whose contents stay beside the article even where they hold an article of their own, such as a teaser.
APART_TAGS = frozenset("nav footer aside menu dialog".split())


def element_flags(tag: str, names: str, role: str, outer: int) -> int:
    """Flags inside an element, from its tag, class and id names, role and the flags around it."""
    flags = outer
    words = {w.lower() for w in _NAME.findall(names)} if names else frozenset()
    if tag in UNREAD_TAGS:
        flags |= UNREAD
    if tag in APART_TAGS:
        flags |= APART
    if tag in MAIN_TAGS or role == "main":
        # what a wrapper outside of the main part says of itself (layout, form, search page) does not hold inside it
        if not outer & MAIN and not (tag == "article" and outer & APART):
            flags &= ~SIDE
        flags |= MAIN
    if tag in SIDE_TAGS or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"):
        flags |= SIDE
    if words & COMMENT_WORDS:
        flags |= COMMENT
    if words & SIDE_WORDS and tag not in ("body", "html"):
        flags |= SIDE
    elif words & MAIN_WORDS and not words & COMMENT_WORDS:
        flags |= MAIN
    if (tag == "header" or "header" in words and not words & MAIN_WORDS) and not outer & MAIN and tag not in HEADINGS:
        flags |= SIDE
    if tag == "a":
        flags |= LINK
    if tag in HEADINGS:
        flags |= HEADING
    return flags


class _Blocks(HTMLParser):
    """Collects (text, words, words in links, flags) of the blocks of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int]] = []
        self.open: list[tuple[str, int]] = []
        self.counts: Counter = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.flags = 0

    def parse_marked_section(self, i, report=1):
        """Sections that the parser does not know, such as ``<![foo[ x ]]>``, are comments up to the next ``>``, as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i + 3)
            return end + 1 if end >= 0 else -1

    def _end_block(self) -> None:
        words = "".join(self.parts).split()
        if words:
            self.blocks.append((" ".join(words), len(words), min(self.linked, len(words)), self.flags))
        self.parts, self.linked = [], 0

    def _pop(self, size: int) -> None:
        for tag, _ in self.open[size:]:
            self.counts[tag] -= 1
        del self.open[size:]

    def _close(self, tags: tuple[str, ...], stop: frozenset[str] = frozenset()) -> bool:
        if not any(self.counts[t] for t in tags):
            return False
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self._pop(i)
                return True
            if self.open[i][0] in stop:
                return False
        return False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self._end_block()
            self._close(("p",), BLOCK_TAGS - {"p"})
        if tag in CLOSED_BY:
            self._close(tuple(CLOSED_BY[tag].split()), frozenset(("ul", "ol", "dl", "table", "select")))
        if tag in SPACE_TAGS:
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        names, role = "", ""
        for key, value in attrs:
            if key in ("class", "id"):
                names += f" {value or ''}"
            elif key == "role":
                role = (value or "").lower()
        self.open.append((tag, element_flags(tag, names, role, self.open[-1][1] if self.open else 0)))
        self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self._end_block()
        if tag not in VOID_TAGS:
            self._close((tag,))

    def handle_data(self, data):
        flags = self.open[-1][1] if self.open else 0
        if flags & UNREAD:
            return
        if data.strip():
            if not any(map(str.strip, self.parts)):
                self.flags = flags & ~LINK
            if flags & LINK:
                self.linked += len(data.split())
        self.parts.append(data)


def blocks(html: str) -> list[tuple[str, int, int, int]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._end_block()
    return parser.blocks


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "main", "side", "comment", "heading")


def block_features(words, linked, flags) -> np.ndarray:
    """One row of FEATURES a block; beyond the page's ends there are no words."""
    words, linked, flags = (np.asarray(v, np.int64) for v in (words, linked, flags))
    density = linked / np.maximum(words, 1)
    shifted = lambda v, by: np.concatenate([[0.0], v[:-1]]) if by > 0 else np.concatenate([v[1:], [0.0]])
    return np.stack([
        words, density, shifted(words.astype(float), 1), shifted(density, 1), shifted(words.astype(float), -1), shifted(density, -1),
        *((flags & f > 0).astype(float) for f in (MAIN, SIDE, COMMENT, HEADING))], axis=1)


# Labelled blocks of invented pages: label (1 article), path of tags with .class names, words, words in links. A blank line ends a page.
LABELLED = """
0 body>nav>ul>li 1 1
0 body>nav>ul>li 2 2
0 body>nav>ul>li 1 1
0 body>div.ad 12 0
1 body>article>h1 9 0
1 body>article>p 64 0
1 body>article>p 7 0
1 body>article>p 120 2
1 body>article>p 1 0
0 body>footer 14 0
0 body>footer>p 5 2

0 body>header>h1 3 1
0 body>header>p 11 0
0 body>div.menu>ul>li 2 2
0 body>div.menu>ul>li 1 1
1 body>main>h1 6 0
1 body>main>p 41 1
1 body>main>ul>li 5 0
1 body>main>ul>li 12 0
0 body>main>div.advert>p 25 4
1 body>main>h2 3 0
1 body>main>p 88 3
1 body>main>blockquote>p 17 0
0 body>main>aside>p 38 1
0 body>main>form>label 4 0
0 body>main>div.share>ul>li 1 1
0 body>section.comments>h2 2 0
0 body>section.comments>div>p 33 0
0 body>section.comments>div>p 8 0
0 body>footer>ul>li 2 2

0 body>div.cookie.notice>p 28 3
0 body>div.topbar 6 2
1 body>div.content>h1 8 0
1 body>div.content>p 52 0
1 body>div.content>p 9 0
0 body>div.content>div.related>h3 2 0
0 body>div.content>div.related>ul>li 9 9
0 body>div.content>div.related>ul>li 7 7
1 body>div.content>p 30 0
0 body>div.content>div.newsletter>p 19 0
0 body>div.comments>p 46 0
0 body>div.comments>p 71 1
0 body>div.sidebar>h3 2 0
0 body>div.sidebar>p 35 1
0 body>div.footer>p 22 4

0 body>div>a 1 1
0 body>div>a 2 2
0 body>div 4 4
0 body>div>h1 3 0
1 body>div>p 61 1
1 body>div>p 34 0
1 body>div>p 90 4
1 body>div>p 26 0
0 body>div>ul>li 3 3
0 body>div>ul>li 4 4
0 body>div 7 2

1 body>p 48 0
1 body>p 55 2
1 body>p 40 0
0 body>p 5 5
0 body>p 3 3

0 body>article.comment>p 40 0
0 body>article>div.comments>p 18 0
0 body>article>section.comments>p 52 2
1 body>article>table>tr 6 0
1 body>article>table>tr 4 0
1 body>article>p 2 2
1 body>article>figure>figcaption 8 0
1 body>article>pre 13 0
1 body>article>ul>li 3 3
1 body>article>h3 2 0
0 body>article>nav>ul>li 4 4
0 body>article>footer>p 9 1
0 body>article>form>p 12 0
0 body>article>div.ad>p 31 0

1 body>form>p 64 0
1 body>form>p 120 2
1 body>form>p 88 0
1 body>form>p 71 0

0 body>div.widget>h3 2 0
1 body>div.widget>p 95 0
1 body>div.widget>p 76 1
1 body>div.widget>p 110 0
0 body>div.widget>ul>li 4 4

0 body>div.banner 9 1
0 body>header>nav>ul>li 1 1
0 body>header>div 5 0
1 body>main>article>header>h1 7 0
1 body>main>article>header>p 15 0
1 body>main>article>section>p 77 0
1 body>main>article>section>p 23 5
1 body>main>article>section>h2 4 0
1 body>main>article>section>p 4 0
0 body>main>article>div.promo>p 16 2
1 body>main>article>section>p 58 0
0 body>main>div.pager>a 2 2
0 body>dialog>p 21 1
0 body>aside>p 44 0
0 body>aside>ul>li 6 6
0 body>footer>div>p 30 0
0 body>footer 3 0
"""


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of LABELLED."""
    rows, labels = [], []
    for page in LABELLED.strip().split("\n\n"):
        words, linked, flags = [], [], []
        for line in page.splitlines():
            label, path, n, m = line.split()
            state = 0
            for element in path.split(">"):
                tag, *names = element.split(".")
                state = element_flags(tag, " ".join(names), "", state)
            words.append(int(n))
            linked.append(int(m))
            flags.append(state)
            labels.append(int(label))
        rows.append(block_features(words, linked, flags))
    return np.concatenate(rows), np.array(labels)


class Tree:
    """Binary decision tree by Gini impurity; ties go to the earlier feature and the lower threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.feature, self.bound, self.left, self.right, self.share = [], [], [], [], []
        self._grow(x, y, depth, least)

    def _grow(self, x, y, depth, least) -> int:
        node = len(self.feature)
        for column, value in ((self.feature, -1), (self.bound, 0.0), (self.left, -1), (self.right, -1), (self.share, float(y.mean()))):
            column.append(value)
        best = (1e-12, -1, 0.0)
        if depth and 0 < y.sum() < len(y):
            whole = y.mean() * (1 - y.mean()) * len(y)
            for j in range(x.shape[1]):
                values = np.unique(x[:, j])
                for bound in (values[1:] + values[:-1]) / 2:
                    low = x[:, j] <= bound
                    a, b = y[low], y[~low]
                    if min(len(a), len(b)) >= least:
                        gain = whole - a.mean() * (1 - a.mean()) * len(a) - b.mean() * (1 - b.mean()) * len(b)
                        if gain > best[0] + 1e-12:
                            best = (gain, j, bound)
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            self.feature[node], self.bound[node] = best[1], best[2]
            self.left[node] = self._grow(x[low], y[low], depth - 1, least)
            self.right[node] = self._grow(x[~low], y[~low], depth - 1, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of article blocks in the leaf of each row."""
        feature, bound, left, right = (np.array(v) for v in (self.feature, self.bound, self.left, self.right))
        node = np.zeros(len(x), np.int64)
        while (inner := feature[node] >= 0).any():
            rows = np.flatnonzero(inner)
            at = node[rows]
            node[rows] = np.where(x[rows, feature[at]] <= bound[at], left[at], right[at])
        return np.array(self.share)[node]


def main_text(html: str | None, tree: Tree) -> str:
    found = blocks(html) if html else []
    if not found:
        return ""
    texts, words, linked, flags = zip(*found)
    keep = tree.predict(block_features(words, linked, flags)) >= 0.5
    return "\n\n".join(t for t, k in zip(texts, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with the article's text and its length n_chars in place of ``html``; columns named text or n_chars are replaced."""
    tree = Tree(*labelled_table())

    @F.pandas_udf("string")
    def texts(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, tree) for _, run in text_chunks(batch) for h in run], dtype=object)

    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars", "html")]
    return pages.select(*kept, texts(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
