"""Main text of web pages by the maximum-scoring subsequence.

A page is a row of pieces: each word of a text scores positive, each tag negative. The weights are log odds of standing
inside the main element, learnt from labelled pages (those that mark their main text with a single article or main
element). One linear scan finds the contiguous region with the highest sum; it then grows to the element that holds it,
and loses what its markup declares not to be text of the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import full_text, table

#: Pages that weights are learnt from (about, by hash of the id), and weights without any; words weigh one.
FIT_PAGES = 1500
TAG_WEIGHT, LEAST, MOST = -3.25, -8.0, -0.4
OUTSIDE = -1.0

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|textarea|title|iframe"
EMBEDDED = frozenset("template select svg math object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav aside form footer button dialog menu head fieldset search header".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre dd dt td th figcaption caption".split())
#: Elements of running text: no class name sets them aside.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption".split())
#: Opening one of these ends an open element of the second kind.
ENDS = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}
# Words of class, id and role attributes that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation"
    " menu menubar breadcrumb breadcrumbs masthead topbar header footer sidebar aside complementary contentinfo widget widgets related recommended"
    " recommendations comment comments commentlist disqus discussion reply replies respond responses cookie cookies consent gdpr notice notices"
    " notification alert popup modal overlay dialog newsletter subscribe subscription signup login share sharing social toolbar pagination pager"
    " skip copyright disclaimer search form paywall thread threads".split()
)
INNER = MARKS - {"header", "banner"}
# Words that may stand beside those in a class name and leave its meaning as it is.
AROUND = frozenset(
    "article aside area bar block blog body bottom box btn button buttons card cards col column container content cta feed field fixed global grid group in inline"
    " inner input item items left link links list main mobile nav page panel post posts primary right row secondary section site slot small sticky story stories"
    " the top unit user users view wrap wrapper x".split()
)

#: Elements that an open paragraph, and an open item or cell, are not ended across.
BLOCK_WALLS = (BLOCK | EMBEDDED) - {"p"}
LIST_WALLS = EMBEDDED | frozenset(("ul", "ol", "dl", "table", "select"))
#: Up to the slash that closes a tag, which is no part of an attribute, or to its end; a slash in an unquoted value is part of that.
_ATTRIBUTES = r"(?:=\s*+[^\s>\"']*+|[^>\"'=/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+"
_PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){_ATTRIBUTES}(?:/>|>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z))"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES}/?)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|([^<]++)|<",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def _marked(name: str, marks: frozenset[str]) -> bool:
    """Whether a class name, id or role is made of marks, and of words and numbers that only say where or how."""
    words = {w.lower() for w in _PARTS.split(name) if w}
    return bool(words & marks) and all(w in marks or w in AROUND or len(w) < 2 or not w.isalpha() for w in words)


class Page:
    """Elements (name, attributes, parent, first and last piece) and pieces (element, text; or element and None for a tag)."""

    def __init__(self, source: str):
        self.names, self.attributes, self.parents, self.first, self.last = ["#page"], [""], [-1], [0], [0]
        self.pieces: list[tuple[int, str, str | None]] = []
        stack = [0]
        # places in the stack: of each name, and of the walls of both kinds, so that no tag looks through all that is open
        self.open: dict[str, list[int]] = defaultdict(list)
        self.walls: dict[frozenset, list[int]] = {BLOCK_WALLS: [0], LIST_WALLS: [0]}
        for m in _PIECE.finditer(source):
            text = m[8]
            if text is None and m[0] == "<":
                text = "<"
            if text is not None:
                self.pieces.append((stack[-1], "", text))
                continue
            name = (m[3] or m[6] or "").lower()
            if not name:
                continue
            closing = bool(m[2] or m[5])
            if closing:
                if self.open[name]:
                    (self._drop if name in EMBEDDED else self._close)(stack, self.open[name][-1])
                if name not in EMBEDDED:
                    self.pieces.append((stack[-1], name, None))
                continue
            if name in BLOCK:
                self._end(stack, "p", BLOCK_WALLS)
            if name in ENDS:
                self._end(stack, name, LIST_WALLS)
                self._end(stack, ENDS[name], LIST_WALLS)
            if name not in EMBEDDED:
                self.pieces.append((stack[-1], name, None))
            if name not in VOID and not (name in ("svg", "math") and (m[4] or "").endswith("/")):
                self.names.append(name)
                self.attributes.append((m[4] or m[7] or "").strip())
                self.parents.append(stack[-1])
                self.first.append(len(self.pieces))
                self.last.append(-1)
                self.open[name].append(len(stack))
                for names, places in self.walls.items():
                    if name in names:
                        places.append(len(stack))
                stack.append(len(self.names) - 1)
        self._close(stack, 0)
        self._open_embedded()

    def _forget(self, stack: list[int], k: int) -> None:
        """Take what is open from place k on off the stack."""
        for e in stack[k:]:
            if self.open[self.names[e]]:
                self.open[self.names[e]].pop()
        for places in self.walls.values():
            while places[-1] >= max(k, 1):
                places.pop()
        del stack[k:]

    def _drop(self, stack: list[int], k: int) -> None:
        """Forget an embedded element that its own end tag closes, and all it holds."""
        e = stack[k]
        self._forget(stack, k)
        del self.pieces[self.first[e] :]
        for column in (self.names, self.attributes, self.parents, self.first, self.last):
            del column[e:]

    def _open_embedded(self) -> None:
        """What follows an embedded element without an end tag is text of the page: it belongs to the element around."""
        if EMBEDDED.isdisjoint(self.names):
            return
        home = list(range(len(self.names)))
        for e in range(1, len(home)):
            self.parents[e] = home[self.parents[e]]
            if self.names[e] in EMBEDDED:
                home[e], self.attributes[e] = self.parents[e], ""
        self.pieces = [(home[e], name, text) for e, name, text in self.pieces]

    def _close(self, stack: list[int], k: int) -> None:
        for e in stack[k:]:
            self.last[e] = len(self.pieces)
        self._forget(stack, k)

    def _end(self, stack: list[int], name: str, walls: frozenset) -> None:
        """Close the innermost open element of a name, unless it stands outside of a wall."""
        if self.open[name] and self.open[name][-1] > self.walls[walls][-1]:
            self._close(stack, self.open[name][-1])

    def main_element(self) -> int | None:
        """The only article or main element (of nested ones the innermost), None if there is none or there are several."""
        around = [False] * len(self.names)
        inner = []
        for e in range(len(self.names) - 1, 0, -1):
            if self.names[e] in MAIN and not around[e]:
                inner.append(e)
            around[self.parents[e]] |= around[e] or self.names[e] in MAIN
        return inner[0] if len(inner) == 1 else None

    def set_aside(self) -> list[bool]:
        """Which elements are, or stand in, a menu, header, footer, sidebar, notice, advert, form or discussion."""
        n = len(self.names)
        holds = [False] * n
        for e in range(n - 1, 0, -1):
            holds[self.parents[e]] |= holds[e] or self.names[e] in MAIN or self.names[e] == "h1"
        out, inside = [False] * n, [False] * n
        for e in range(1, n):
            name, above = self.names[e], self.parents[e]
            inside[e] = inside[above] or name in MAIN
            marks = self.attributes[e]
            if out[above]:
                out[e] = True
            elif name in ASIDE:
                out[e] = not (name in ("header", "fieldset") and inside[above]) and not (name == "form" and holds[e])
            elif marks and name not in MAIN and name not in ("html", "body"):
                if _HIDDEN.search(marks):
                    out[e] = True
                elif not holds[e] and name not in RUNNING:
                    out[e] = any(_marked(n, INNER if inside[above] else MARKS) for a, b, c in _NAMED.findall(marks) for n in (a or b or c).split())
        return out


def best_region(scores: list[float]) -> tuple[int, int] | None:
    """Start and end of the contiguous run with the highest sum above zero; of equal ones the first, and of those the shortest."""
    best = total = 0.0
    begin, found = 0, None
    for k, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += score
        if total > best:
            best, found = total, (begin, k + 1)
    return found


def _scores(page: Page, aside: list[bool], weights: dict[str, float]) -> Iterator[float]:
    for element, name, text in page.pieces:
        if text is None:
            yield weights.get(name, TAG_WEIGHT)
        else:
            yield (OUTSIDE if aside[element] else 1.0) * len(text.split())


def _heading(page: Page, aside: list[bool], low: int) -> int | None:
    """The page's only h1, if it ends before the region and is not set aside."""
    found = [e for e, name in enumerate(page.names) if name == "h1" and not aside[e]]
    return found[0] if len(found) == 1 and page.last[found[0]] <= low else None


def main_text(page: Page, weights: dict[str, float], lists: bool = True) -> str:
    """The blocks of the page's main region, one per line; without lists nothing is set aside by element or class name."""
    aside = page.set_aside() if lists else [False] * len(page.names)
    region = best_region(list(_scores(page, aside, weights)))
    if region is None:
        return ""
    low, high = region
    home = _home(page, aside, low, high)
    if home is not None and page.names[home] not in ("html", "body", "#page"):
        low, high = page.first[home], page.last[home]
        prose = None
    else:
        prose = _in_prose(page, home) if home is not None else None
    title = _heading(page, aside, low)
    blocks: list[str] = []
    now: list[str] = []

    def end() -> None:
        if now:
            line = _SPACE.sub(" ", html.unescape("".join(now))).strip()
            if line:
                blocks.append(line)
            now.clear()

    for k, (element, name, text) in enumerate(page.pieces):
        if text is None:
            if name in BLOCK:
                end()
            elif name == "br":
                now.append(" ")
        elif not aside[element] and (low <= k < high or (title is not None and page.first[title] <= k < page.last[title]) or (prose is not None and prose[element])):
            now.append(text)
    end()
    return "\n".join(blocks)


def _home(page: Page, aside: list[bool], low: int, high: int) -> int | None:
    """The innermost element that holds all of the region's own text."""
    inside = [(k, e) for k, (e, _, text) in enumerate(page.pieces[low:high], low) if text is not None and not aside[e] and text.strip()]
    if not inside:
        return None
    home = inside[0][1]
    while home > 0 and not (page.first[home] <= inside[0][0] and inside[-1][0] < page.last[home]):
        home = page.parents[home]
    prose = np.concatenate([[0], np.cumsum([text is None and name in PROSE for _, name, text in page.pieces], dtype=np.int64)])

    def is_layout_cell(e: int) -> bool:
        """Whether a table cell holds blocks of its own, besides its end tag."""
        return page.names[e] in ("td", "th") and prose[max(page.last[e] - 1, page.first[e])] > prose[page.first[e]]

    while home > 0 and (page.names[home] not in BLOCK or page.names[home] in PROSE) and not is_layout_cell(home):
        home = page.parents[home]
    return home


def _in_prose(page: Page, home: int) -> list[bool]:
    """Of each element, whether its text belongs to a heading, paragraph or list right below home, the page's body."""
    out = [False] * len(page.names)
    # the innermost block around each element, and the outermost list around that; parents stand before their children
    block, top = list(range(len(out))), list(range(len(out)))
    for e in range(1, len(out)):
        name, above = page.names[e], page.parents[e]
        if name not in BLOCK:
            block[e] = block[above]
        if name in ("li", "ul", "ol") and above > 0 and above != home:
            top[e] = top[above]
        found = top[block[e]]
        out[e] = page.parents[found] == home and (page.names[found] in PROSE or page.names[found] in ("ul", "ol"))
    return out


def _count_tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tags and words (as #word) inside and outside the main elements of labelled pages."""
    counts = Counter()
    for b in batches:
        for x in b.column(0):
            page = Page(x.as_py())
            if (e := page.main_element()) is not None:
                for k, (_, name, text) in enumerate(page.pieces):
                    inside = page.first[e] <= k < page.last[e]
                    if text is None:
                        counts[name, inside] += 1
                    else:
                        counts["#word", inside] += len(text.split())
    rows = [(name, inside, n) for (name, inside), n in counts.items()]
    names, inside, n = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(inside, pa.bool_()), pa.array(n, pa.int64())], ["name", "inside", "n"])


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = FIT_PAGES) -> dict[str, float]:
    """Weights of tags, in words: the log odds of standing inside, over those of a word, kept between LEAST and MOST.

    Learnt from about `rows` distinct pages, chosen by a hash of id and page; the driver sees the tag names of these. Others, and
    all of them without labelled pages, weigh TAG_WEIGHT.
    """
    hashed = pages.select(F.xxhash64(id_col, html_col, F.lit("html")).alias("u"), full_text(html_col).alias("_html"))
    total = max(hashed.agg(F.approx_count_distinct("u")).first()[0], 1)
    drawn = hashed.where(F.shiftrightunsigned("u", 1) / float(1 << 63) < rows / total)
    sample = drawn.groupBy("u").agg(F.min("_html").alias("_html")).select("_html")
    counted = sample.mapInArrow(_count_tags, "name string, inside boolean, n bigint").groupBy("name").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n")
    )
    found = {r["name"]: (r["a"], r["n"]) for r in counted.collect()}
    whole = sum(a for a, _ in found.values()), sum(n - a for a, n in found.values())
    if min(whole) == 0 or "#word" not in found:
        return {}

    def odds(name: str) -> float:
        a, n = found[name]
        return log((a + 0.5) / (whole[0] + 1)) - log((n - a + 0.5) / (whole[1] + 1))

    word = max(odds("#word"), 0.1)
    return {name: float(np.clip(odds(name) / word, LEAST, MOST)) for name in found if name != "#word"}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars of every row of pages.

    A null page counts as empty and has an empty text, like one without words outside menus and the like. Rows that repeat
    are all returned and count once in the fit; of equally good regions the first counts; a page of any length is read whole; an
    empty table gives an empty result; further columns are ignored.
    """
    weights = learn_weights(pages, id_col, html_col)
    rows = pages.select(id_col, url_col, full_text(html_col).alias("_html"))
    schema = pages.select(id_col, url_col, F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(Page(x.as_py()), weights) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names
            )

    return rows.mapInArrow(run, schema)


def op9_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
