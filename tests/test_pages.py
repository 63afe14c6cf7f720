"""Page texts: malformed pages, references, scores, time."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidewire.sources import pages


def lines(html):
    return [b[0] for b in pages.best_blocks(html)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, []),
        ("", []),
        ("plain & simple", ["plain & simple"]),
        ("<p>It&#8217;s caf&eacute; &amp;amp; &lt;b&gt;", ["It’s café &amp; <b>"]),
        ("&#" + "9" * 5000 + ";x", ["&#" + "9" * 5000 + ";x"]),
        ("<article>one</article> ad ad <article>two</article>", ["one", "two"]),
        ("<body><div>menu</div><main><p>a<p>b</main>foot", ["a", "b"]),
        ("<nav>menu</nav><p>text", ["text"]),
        ("<nav>never closed <p>text", ["never closed", "text"]),
        ("<div><nav>closed by its holder</div><p>text</p></nav>more", ["text", "more"]),
        ("<p>a < b and 1<2 <3", ["a < b and 1<2 <3"]),
        ("<p>cut <a href='x", ["cut <a href='x"]),
        ('<p><img alt="a > b">seen</p>', ["seen"]),
        ('<p title="open>seen', ["seen"]),
        ("<p don't>seen<p it's>too", ["seen", "too"]),
        ("<!-- <p>hidden</p> -->a<!--open <p>gone", ["a"]),
        ("<script>if (a < b) '</p>'</script>a<style>b{}</style>c", ["ac"]),
        ("<SCRIPT>x</ScRiPt >İ a<Nav>b</NAV>", ["İ a"]),
        ("a<br>b<br/>c</p>d", ["a", "b", "c", "d"]),
        ("<form><form>x</form>y</form>z", ["z"]),
        ("</div></nav></article>a", ["a"]),
    ],
)
def test_blocks(html, want):
    assert lines(html) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("&amp;&amp;&amp", "&&&amp"),  # a title cut inside its last reference
        ("&ampx; &nosuch; a&b;", "&ampx; &nosuch; a&b;"),
        ("&#65;&#x42;&copy;&#67", "AB©&#67"),
        ("&amp;copy; &copy", "&copy; &copy"),
    ],
)
def test_references_end_with_a_semicolon(text, want):
    assert lines(f"<p>{text}</p>") == [want]


def test_links_are_counted():
    (block,) = pages.read_blocks("<p>ab <a href=x>c &amp; d</a> e<a>f")
    assert block == ("ab c & d ef", 7, 4, 5, 0)


class _Plain(HTMLParser):
    """The same reading by another parser, for pages whose elements are all closed."""

    def __init__(self):
        super().__init__()
        self.stack, self.now, self.out = [], "", []

    def cut(self):
        if self.now.split():
            self.out.append((" ".join(self.now.split()), max([len(pages.MAIN) - pages.MAIN.index(n) for n in self.stack if n in pages.MAIN], default=0)))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in pages.BREAKS:
            self.cut()
        if tag not in ("br", "img"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in pages.BREAKS:
            self.cut()
        assert self.stack.pop() == tag

    def handle_data(self, data):
        if not set(self.stack) & set(pages.DROPPED):
            self.now += data


def page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "void", "comment", "element"])
        if kind == "element" and depth < 5:
            name = rng.choice(["p", "div", "article", "main", "nav", "b", "a", "ul", "li", "aside", "form", "h1"])
            out.append(f'<{name} class="x > y">{page(rng, depth + 1)}</{name}>')
        else:
            out.append({"void": "<br>", "comment": "<!-- <p>no -->"}.get(kind, rng.choice(["one ", "two &amp; ", " é&nbsp;x", "\n", "long text here"])))
    return "".join(out)


def test_well_formed_pages_equal_another_parser():
    rng = random.Random(4)
    for _ in range(400):
        html = f"<html><body>{page(rng)}</body></html>"
        plain = _Plain()
        plain.feed(html)
        plain.cut()
        assert [(b[0], b[4]) for b in pages.read_blocks(html)] == plain.out


BAD = ["<nav>", "<!--", "<a", "<", "</div>", "<div>", "<article>", "<p a='", '<p a="x>', "&", "<script>", "</", "<a href=x>b", "<svg/>", "<title>", "<!-- -->", "<p \"'>", "<!", "&#1"]


@pytest.mark.parametrize("piece", BAD)
def test_time_is_linear(piece):
    began = time.process_time()
    pages.read_blocks(piece * (1_000_000 // len(piece)))
    pages.read_blocks(f"<nav>{piece}" * (1_000_000 // (len(piece) + 5)) + "</nav>")
    assert time.process_time() - began < 8


def test_scores_drop_link_lists_and_short_lines(spark):
    prose = "Officials said on Monday that the talks would go on for another week, as neither side had moved, and that more news was due"
    menu = "".join(f"<li><a href=x>Section {i}</a></li>" for i in range(5))
    html = f"<body><ul>{menu}</ul><div>Share</div><div>Print</div><h1>Talks go on in the capital</h1><p>{prose}.</p><p>{prose} soon.</p><div>More</div><ul>{menu}</ul><div>Imprint</div></body>"
    article = f"<body><article><h2>Short</h2><p>Yes.</p><p><a>only a link</a></p></article>{html}</body>"
    rows = pages.with_main_text(spark.createDataFrame([(1, html), (2, article), (3, None), (4, "")], "i int, h string"), F.col("h"), "t").collect()
    got = {r["i"]: r["t"].split("\n") for r in rows}
    assert got == {1: ["Talks go on in the capital", f"{prose}.", f"{prose} soon.", "More"], 2: ["Short", "Yes."], 3: [""], 4: [""]}


def test_second_body_only_where_the_first_does_not_do(spark):
    long = "<p>" + "word " * 30
    rows = [(1, long, "<p>unused " * 9, "s", 200), (2, "short", long, "s", 200), (3, long, long, "a summary of the story", 404), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, a string, b string, s string, st int")
    got = {r["i"]: (r["article_text"], r["extraction_method"]) for r in pages.article_texts(df, "a", "b", "s", "st").collect()}
    text = ("word " * 30).strip()
    assert got == {1: (text, "Extracted"), 2: (text, "Extracted"), 3: ("a summary of the story", "Fallback-Summary"), 4: (None, "Failed")}
    assert re.search("ArrowEvalPython", pages.article_texts(df, "a", "b", "s")._jdf.queryExecution().executedPlan().toString())
