"""The text of web pages: one pass of tokens, then scores of the text blocks.

``blocks`` reads a page's tags once, with a stack of the elements that matter, and
gives the blocks of text between block elements with what the scores need: how
many characters and words each has, and how many characters stand in links.
Choosing among them is a column expression (``is_prose``).
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tidewire.storage import importable

# The least length of a text and of a summary that stands in, and
# the answers of a server after which a page is not asked for again.
LEAST_TEXT, LEAST_SUMMARY = 50, 20
HARD_ERRORS = [401, 403, 404, 410, 500]
EXTRACTED, SUMMARY, FAILED = "Extracted", "Fallback-Summary", "Failed"
#: Elements that hold no prose of the page, those of them whose content is no
#: markup, and those that may hold all of the prose, the best first.
DROPPED = ["script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe", "svg", "table", "figure", "button", "title", "textarea", "select", "template"]
RAW = ["script", "style", "title", "textarea", "iframe"]
MAIN = ["article", "main", "body"]
#: Other elements whose end also ends what is open inside.
HOLDERS = ["div", "section", "blockquote", "td", "li", "html"]
BREAKS = ["br", "p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "body", "blockquote", "pre", "hr", "dl", "dt", "dd", "tr", "td", "th", "html", *[t for t in DROPPED if t not in ("script", "style", "noscript", "svg", "template", "button")]]
#: The published rule of shallow text features: link densities of this block and
#: the one before it, words of this block, the next and the one before.
LINKS, LINKS_BEFORE, WORDS, WORDS_AFTER, WORDS_BEFORE, WORDS_LISTED, WORDS_AFTER_LISTED = 1 / 3, 0.555556, 16, 15, 4, 40, 17
#: Characters that count as a word at least, for scripts without spaces.
WORD_CHARS = 8

_NAME = re.compile("</?([a-zA-Z][a-zA-Z0-9:-]*)")
_END = re.compile("[>\"']")
_REFERENCE = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([a-zA-Z][a-zA-Z0-9]*));")
_ASSIGNED = re.compile(r"=\s*$")
_KIND = pa.list_(pa.struct([("text", pa.string()), ("chars", pa.int32()), ("links", pa.int32()), ("words", pa.int32()), ("region", pa.int32())]))


def _character(reference: re.Match) -> str:
    try:
        return html5.get(reference[1] + ";", reference[0]) if reference[1] else unescape(reference[0])
    except ValueError:
        return reference[0]


def decoded(text: str) -> str:
    """Character references as characters; those that are cut off before their
    semicolon, unknown names and numbers of thousands of digits stay as they are."""
    return _REFERENCE.sub(_character, text) if "&" in text else text


class _Page:
    """What the reader of a page knows: open elements, the block so far, finished blocks."""

    def __init__(self):
        self.open: list[str] = []
        self.count = Counter()
        self.link_at = -1  # how many elements were open when the link began
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.found: list[tuple[str, int, int, int, int]] = []

    def text(self, raw: str) -> None:
        if raw and not self.count["dropped"]:
            text = decoded(raw)
            self.parts.append(text)
            if self.link_at >= 0:
                self.linked.append(text)

    def flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                text = " ".join(words)
                chars, links = sum(map(len, words)), sum(map(len, "".join(self.linked).split()))
                region = next((len(MAIN) - i for i, name in enumerate(MAIN) if self.count[name]), 0)
                self.found.append((text, chars, links, max(len(words), len(text) // WORD_CHARS), region))
            self.parts, self.linked = [], []

    def start(self, name: str) -> None:
        self.open.append(name)
        self.count[name] += 1
        self.count["dropped"] += name in DROPPED

    def end(self, name: str) -> None:
        if self.count[name]:
            while True:
                last = self.open.pop()
                self.count[last] -= 1
                self.count["dropped"] -= last in DROPPED
                if last == name:
                    break
            if len(self.open) < self.link_at:
                self.link_at = -1


def _tag_end(html: str, at: int, absent: set[str]) -> int:
    """The place of the ``>`` that ends a tag, not one in a quoted value; -1 if there is none."""
    while m := _END.search(html, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if m[0] not in absent and _ASSIGNED.search(html, max(m.start() - 8, 0), m.start()):
            close = html.find(m[0], at)
            if close < 0:
                absent.add(m[0])
            else:
                at = close + 1
    return -1


def read_blocks(html: str) -> list[tuple[str, int, int, int, int]]:
    """``text, chars, links, words, region`` of a page's blocks, in one pass.

    Every tag is looked at once and every closed element leaves the stack once,
    so the time is in proportion to the page, however badly it is formed. An
    element ends with its end tag or with that of an element around it. Elements
    of ``DROPPED`` that no end tag follows are not opened; what follows an open
    comment goes; a ``<`` that begins no tag, or no whole one, is text.
    """
    lower = html.lower()
    if len(lower) != len(html):  # a letter whose lower case is two
        lower = "".join(c.lower() if c < "\x80" else c for c in html)
    last = {name: lower.rfind("</" + name) for name in DROPPED}
    page, at, absent = _Page(), 0, set()
    while (i := html.find("<", at)) >= 0:
        page.text(html[at:i])
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            if end < 0:
                at = len(html)
                break
            at = end + 3
            continue
        m = _NAME.match(html, i)
        if not m and html[i + 1 : i + 2] not in ("!", "?", "/"):
            page.text("<")
            at = i + 1
            continue
        end = _tag_end(html, m.end() if m else i + 1, absent)
        if end < 0:
            at = i
            break
        at = end + 1
        if not m:
            continue
        name = m[1].lower()
        if name in BREAKS:
            page.flush()
        closing = html[i + 1] == "/"
        if name == "a":
            page.link_at = -1 if closing else len(page.open)
        elif closing:
            if page.count[name]:
                page.end(name)
        elif html[end - 1] == "/" and name == "svg":
            pass
        elif name in DROPPED:
            if last[name] >= at:
                page.start(name)
                if name in RAW:
                    at = lower.find("</" + name, at)
        elif name in MAIN or name in HOLDERS:
            page.start(name)
    page.text(html[at:])
    page.flush()
    return page.found


def best_blocks(html: str | None) -> list[tuple[str, int, int, int, int]]:
    """The blocks of the page's best region: its articles, else main, body or all."""
    found = read_blocks(html or "")
    best = max((b[4] for b in found), default=0)
    return [b for b in found if b[4] == best]


_BLOCK = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("chars", "links", "words", "region")]])


@arrow_udf(T.ArrayType(_BLOCK))
def blocks(html: pa.Array) -> pa.Array:
    sizes, flat = [0], []
    for page in html.to_pylist():
        flat += best_blocks(page)
        sizes.append(len(flat))
    columns = [pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True) if flat else [[]] * 5, _KIND.value_type, strict=True)]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_KIND.value_type)))


def is_prose(block: Column, before: Column, after: Column) -> Column:
    """Whether a block belongs to the text. In an article or the main element, all
    that is not mostly links; elsewhere as its density and its neighbours' tell."""
    density = lambda b: F.coalesce(b["links"] / b["chars"], F.lit(0.0))
    words = lambda b: F.coalesce(b["words"], F.lit(0))
    alone = (block["words"] > WORDS) | (words(after) > WORDS_AFTER) | (words(before) > WORDS_BEFORE)
    listed = (block["words"] > WORDS_LISTED) | (words(after) > WORDS_AFTER_LISTED)
    told = F.when(density(before) <= LINKS_BEFORE, alone).otherwise(listed)
    return (density(block) <= LINKS) & ((block["region"] > 1) | told)


def with_main_text(df: DataFrame, html: Column, name: str) -> DataFrame:
    """``df`` with the lines of a page's prose; '' if it has none. Null counts as empty."""
    importable(df.sparkSession)
    found = df.withColumn(f"{name}_blocks", blocks(html))
    page = F.col(f"{name}_blocks")
    kept = F.filter(page, lambda b, i: is_prose(b, F.get(page, i - 1), F.get(page, i + 1)))
    return found.withColumn(name, F.array_join(F.transform(kept, lambda b: b["text"]), "\n")).drop(f"{name}_blocks")


def article_texts(df: DataFrame, first: str, second: str, summary: str, status: str | None = None) -> DataFrame:
    """``df`` with ``article_text`` and ``extraction_method``.

    The text of the ``first`` body if it is long enough; else that of the
    ``second`` (the page asked for again), unless the ``status`` of the first was
    a hard error; else the summary, if it is long enough; else null. The second
    body is read only where the first does not do.
    """
    soft = ~F.coalesce(F.col(status).isin(HARD_ERRORS), F.lit(False)) if status else F.lit(True)
    enough = lambda c, n: F.coalesce(F.length(F.trim(c)) > n, F.lit(False))
    seen = with_main_text(df, F.when(soft, F.col(first)), "_one")
    seen = with_main_text(seen, F.when(soft & ~enough("_one", LEAST_TEXT), F.col(second)), "_two")
    seen = seen.withColumn("_told", F.trim(F.coalesce(F.col(summary), F.lit(""))))
    one, two, told = enough("_one", LEAST_TEXT), enough("_two", LEAST_TEXT), enough("_told", LEAST_SUMMARY)
    out = seen.withColumns({
        "article_text": F.when(one, F.trim("_one")).when(two, F.trim("_two")).when(told, F.col("_told")),
        "extraction_method": F.when(one | two, EXTRACTED).when(told, SUMMARY).otherwise(FAILED),
    })
    return out.drop("_one", "_two", "_told")


def cached_texts(stored: DataFrame) -> DataFrame:
    """``article_id, article_text`` of stored articles that need not be fetched."""
    return stored.where(F.length("article_text") > LEAST_TEXT).select("article_id", "article_text")


def to_fetch(articles: DataFrame, cached: DataFrame) -> DataFrame:
    """Articles whose text is not cached."""
    return articles.join(cached.select("article_id"), "article_id", "left_anti")
