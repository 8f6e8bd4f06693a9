import random
import time

import numpy as np
import pytest

from quarry.llm import html


def text(page):
    return html.main_text([page], html.model())[0]


BODY = "".join(f"<p>Sentence {w} of the story, told &amp; retold with care.</p>" for w in ("one", "two", "three"))
WANT = " ".join(f"Sentence {w} of the story, told & retold with care." for w in ("one", "two", "three"))
SHELL = "<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>menu a</a><li><a href=/b>menu b</a></ul></nav>{}<footer>&copy; owner of the page</footer></body></html>"


def test_held_out_pages():
    rng = random.Random(123)
    same = 0
    for _ in range(150):
        nodes = html.parse(page := html.synthetic_page(rng))
        same += text(page) == " ".join(n.text for n in nodes if n.text and n.parent.mark)
    assert same >= 140


def test_article_among_its_surroundings():
    assert text(SHELL.format(f"<div class=ad>Buy this now</div><article><h1>The title</h1>{BODY}</article>")) == f"The title {WANT}"
    around = "<div class='cookie-notice'><p>We use cookies on this site.</p></div>"
    after = "<section id=comments><h3>Comments</h3><div class=comment><b>ann</b><p>What a nice story, thanks.</p></div></section>"
    assert text(SHELL.format(f"{around}<main><article>{BODY}<aside class=related><a href=/x>More of it</a></aside></article></main>{after}")) == WANT
    assert text(SHELL.format(f"<div id=content>{BODY}</div><form class=newsletter><p>Sign up</p><input></form>")) == WANT


def test_broken_markup_and_white_space():
    page = SHELL.format("<article><p><b>Bold start of it.<br>next&nbsp; line<p>a <i>x</i>y  <!-- no --> z &lt;3 1 < 2.</article>")
    assert text(page) == "Bold start of it. next line a xy z <3 1 < 2."
    for junk in ("", "<", "<p", "</", "&", "plain", "<!--", "<script>", "<a href='", "<p></div></p>" * 50, "<div>" * 3000, "\x00<p>\x00", "<article>" + "<b>" * 500 + "x"):
        assert isinstance(text(junk), str)


@pytest.mark.parametrize(("inside", "want"), [
    ("<p data-t=o'clock>First of all it began at noon.</p><p>Then it's over, and all went home.</p>", "First of all it began at noon. Then it's over, and all went home."),
    ("<p><img alt=Bob's src=x>Seen by Bob, that day.</p><p>It's the second paragraph of it.</p>", "Seen by Bob, that day. It's the second paragraph of it."),
    ("<p>Before the script there was text.</p><script async src=/js/>var code = 1;</script><p>After the script there was more.</p>", "Before the script there was text. After the script there was more."),
    ("<p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is what we want here.</p>", "The sum x+1 is what we want here."),
    ("<p>Some text before the object came.</p><object data=x><p>Fallback text that is read, too.</p></object><p>And more after it.</p>", "Some text before the object came. Fallback text that is read, too. And more after it."),
    ("<noscript><p>This is read without any script.</p></noscript><p>This is read in any case.</p>", "This is read without any script. This is read in any case."),
    ("<p>Half open <math><mi>y</mi><p>formulas end where a paragraph starts.</p>", "Half open y formulas end where a paragraph starts."),
    ("<p title='a > b'>Signs in values, like these, are no end.</p><!-- <p>no</p> --!><p>Comments end in two ways, too.</p>", "Signs in values, like these, are no end. Comments end in two ways, too."),
    ("<div/><p>A block never closes itself, so this is inside.</p>", "A block never closes itself, so this is inside."),
])
def test_what_an_article_holds(inside, want):
    assert text(SHELL.format(f"<article><h1>Title</h1>{BODY}{inside}</article>")) == f"Title {WANT} {want}"


def test_tokens_by_the_states_of_the_standard():
    got = lambda page: list(html.tokens(page))
    assert got("a<b c=d/ e='f>g' h>i</b x>") == [("text", "a", None), ("start", "b", {"c": "d/", "e": "f>g", "h": ""}), ("text", "i", None), ("end", "b", {"x": ""})]
    assert got("1 < 2 <3 </ x> y<!DOCTYPE q>z<!-->w<!--->v") == [("text", "1 < 2 <3 ", None), ("text", " y", None), ("text", "z", None), ("text", "w", None), ("text", "v", None)]
    assert got("<br/><x a=1 a=2 =b>") == [("/", "br", {}), ("start", "x", {"a": "1", "=b": ""})]
    assert got("<p>x<a href='") == [("start", "p", {}), ("text", "x", None), ("start", "a", {})]
    assert got("<style>p > q</styles></style >r") == [("text", "r", None)]


@pytest.mark.parametrize("junk", ['<a "', "<div>", "<a href='", "<!--", "<p>", "</div>", "<li><ul>", "<td></td><div>", "<b ", "<x y=z ", "&lt", "<table><td>"])
def test_time_grows_with_length(junk):
    page = (junk * (1_000_000 // len(junk)))[:1_000_000]
    began = time.time()
    nodes = html.parse(page)
    assert time.time() - began < 5 and nodes


def test_decoding_equals_all_labellings_of_small_trees():
    generator = np.random.default_rng(5)
    for round_ in range(200):
        root = html.Node("#root", None, [])
        nodes = [root]
        for i in range(generator.integers(1, 10)):
            node = html.Node("#text" if generator.random() < 0.4 else "div", nodes[generator.integers(len(nodes))], [])
            if node.tag == "#text":
                node.text = f"t{i}" * int(generator.integers(1, 9))
            node.hidden = generator.random() < 0.1
            nodes.append(node)
        # document order, which decoding goes by
        order = []
        todo = [root]
        while todo:
            order.append(n := todo.pop())
            todo += reversed(n.children)
        odds = generator.normal(size=len(order)) * 5
        place = {id(n): i for i, n in enumerate(order)}
        worth = [o * (len(n.text) ** 0.5 if n.text else 1.0) for n, o in zip(order, odds, strict=True)]
        best, texts = -1.0, None
        for mask in range(1 << (len(order) - 1)):
            kept = [True, *(bool(mask >> i & 1) for i in range(len(order) - 1))]
            if any(kept[i] and (n.hidden or not kept[place[id(n.parent)]]) for i, n in enumerate(order) if n.parent is not None):
                continue
            total = sum(w for i, w in enumerate(worth) if kept[i] and i)
            if total > best + 1e-9:
                best, texts = total, [n.text for i, n in enumerate(order) if kept[i] and n.text]
        assert html.decode(order, odds) == texts, round_


def test_registered_query_on_the_smallest_pages(spark):
    """Against the article element of each page, read by another parser."""
    from html.parser import HTMLParser

    from quarry.llm.registry import op5_html

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in ("p", "h1", "h2", "li", "blockquote", "article", "div"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.blocks.append("") if tag in ("p", "h1", "article", "div") else None

        def handle_data(self, data):
            if self.inside and self.blocks:
                self.blocks[-1] += data

    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in op5_html(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    same = 0
    for page in pages:
        reader = Article()
        reader.feed(page.html)
        want = " ".join(t for b in reader.blocks if (t := " ".join(b.split())))
        same += got[page.page_id].text == want
        assert got[page.page_id].n_chars == len(got[page.page_id].text) and got[page.page_id].url == page.url
    assert len(got) == len(pages) and same >= 0.99 * len(pages)


def test_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", SHELL.format(f"<article>{BODY}</article>")), (2, None, "")]
    got = sorted(((r.page_id or 0, r.url, r.text) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    assert got == sorted([(1, "u", ""), (2, None, ""), (2, None, ""), (0, "u", WANT)], key=str)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
