"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded over the whole tree.

Every block of a page and every run of text in one is a node with features of itself, its subtree, its siblings and
its ancestors. The trees give each node the odds of being part of the article. Decoding picks the best labelling in
which nothing is kept inside what is dropped, so ancestors and descendants never contradict each other. The trees
learn from pages that `synthetic_page` writes from a seed; no page of the input is a training page.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.gbt import Forest, fit

#: How HTML elements behave.
_RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label img input nobr ruby rt rp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FOREIGN = frozenset(("math", "svg"))
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dt dd main menu nav ol p pre search section summary table ul".split())
_WALLS = ("table", "td", "th", "caption", "template", "object", "button")
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Attribute tokens that tell an article from what surrounds it.
_GOOD = frozenset("article articlebody body content entry main page post story text hentry blogpost prose copy lead".split())
_BAD = frozenset("""ad ads advert advertisement adslot sponsor sponsored promo promotion banner cookie consent gdpr notice alert
nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget footer foot masthead header topbar toolbar
share sharing social related recommended trending more newsletter subscribe signup login search form popup modal overlay
pagination pager tags meta byline author copyright legal skip""".split())
_TALK = frozenset("comment comments commentlist disqus reply replies respond discussion reader reviews thread".split())
_KINDS = {k: i for i, names in enumerate(("nav menu", "header", "footer", "aside", "form fieldset button dialog select option optgroup datalist", "article", "main", "section", "div", "p", "h1 h2", "h3 h4 h5 h6", "li dt dd", "ul ol dl", "table tr td th tbody thead", "blockquote pre figure figcaption", "html body", "#text")) for k in names.split()}
_OTHER = len(set(_KINDS.values()))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP, _ATTR, _IS, _BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_PART = re.compile(r"[a-z]+")
_STOPS = re.compile(r"[.!?,;:]")


class Node:
    __slots__ = ("tag", "parent", "children", "depth", "good", "bad", "talk", "text", "link", "chars", "links", "stops", "paragraphs", "nodes", "longest", "mark", "hidden")

    def __init__(self, tag: str, parent: Node | None, words: list[str]):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.good = self.bad = self.talk = 0
        for w in words:
            self.good += w in _GOOD
            self.bad += w in _BAD
            self.talk += w in _TALK
        self.text, self.link, self.mark, self.hidden = "", 0, False, False
        if parent is not None:
            parent.children.append(self)


def tag_rest(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """(attributes, self-closing, end) of a tag from behind its name, by the states of the HTML tokenizer: a quoted value
    ends at its quote, a bare one at white space or >, the first of two attributes counts. A tag that the page does not
    end takes the rest of it."""
    found: dict[str, str] = {}
    size, closing = len(page), False
    while True:
        gap = _GAP.match(page, at)
        closing, at = gap[0].endswith("/"), gap.end()
        if at >= size:
            return found, False, size
        if page[at] == ">":
            return found, closing, at + 1
        name = _ATTR.match(page, at)
        at, value, told = name.end(), "", _IS.match(page, name.end())
        if told:
            at = told.end()
            if page[at : at + 1] in ('"', "'"):
                end = page.find(page[at], at + 1)
                if end < 0:
                    return found, False, size
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(name[0].lower(), value)


def tokens(page: str):
    """(kind, value, attributes) of a page in one pass: text, start and end tags, and "/" for a self-closing one. What
    scripts, styles and other raw elements hold is left out; comments and declarations are."""
    at, size, text = 0, len(page), 0
    while at < size:
        at = page.find("<", at)
        if at < 0:
            break
        after = page[at + 1 : at + 2]
        slash = after == "/"
        name = _NAME.match(page, at + 1 + slash)
        if not name and not (slash and at + 2 < size) and after not in ("!", "?"):
            at += 1  # a bare < is text
            continue
        if at > text:
            yield "text", page[text:at], None
        if not name:
            if page.startswith("<!--", at):
                short = page[at + 4 : at + 6]
                end = 1 if short[:1] == ">" else 2 if short == "->" else 0
                close = None if end else _COMMENT_END.search(page, at + 4)
                at = at + 4 + end if end else close.end() if close else size
            else:
                end = page.find(">", at + 2)
                at = end + 1 if end >= 0 else size
            text = at
            continue
        tag = name[0].lower()
        attributes, closing, at = tag_rest(page, name.end())
        if not slash and tag in _RAW:
            end = _END[tag].search(page, at)
            at = tag_rest(page, end.end())[2] if end else size
        elif tag not in _RAW:
            yield "end" if slash else "/" if closing else "start", tag, attributes
        text = at
    if size > text:
        yield "text", page[text:], None


class Stack:
    """The open elements, and where each tag lies among them, so no step searches the stack."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of any of these tags, 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tags: tuple[str, ...], walls: tuple[str, ...]) -> bool:
        """Closes the innermost element of these tags and all in it, unless a wall stands further in."""
        at = self.last(*tags)
        if not at or self.last(*walls) > at:
            return False
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()
        return True


def parse(page: str) -> list[Node]:
    """The nodes of a page in document order, the root first; runs of text are #text nodes, decoded and squeezed.

    Elements of formulas and drawings count as inline until one ends them. Only these may close themselves.
    """
    root = Node("#root", None, [])
    nodes, stack, parts, linked, in_link, foreign = [root], Stack(root), [], 0, False, ""

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                leaf = Node("#text", stack.nodes[-1], [])
                leaf.text, leaf.link = text, min(linked, len(text))
                nodes.append(leaf)
        linked = 0

    for kind, value, attributes in tokens(page):
        if kind == "text":
            piece = entities.unescape(value) if "&" in value else value
            parts.append(piece)
            linked += len(piece.strip()) if in_link else 0
            continue
        tag = value
        if tag in _FOREIGN:
            foreign = tag if kind == "start" else "" if kind == "end" else foreign
            continue
        if foreign:
            if tag not in _CLOSES_P:
                continue
            foreign = ""
        if tag in _INLINE:
            if tag == "a":
                in_link = kind != "end"
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        flush()
        in_link = False
        if kind == "end":
            walls = ("table", "template") if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else ("template",) if tag in ("table", "body", "html") else tuple(w for w in _WALLS if w != tag)
            stack.close((tag,), walls)
            continue
        if tag in _CLOSES_P:
            stack.close(("p",), _WALLS)
        if tag in _CLOSES:
            stack.close(*_CLOSES[tag])
        words = [w for k in ("class", "id", "role", "itemprop") if k in attributes for w in _PART.findall(attributes[k].lower())]
        node = Node(tag, stack.nodes[-1], words)
        node.mark = "data-main" in attributes
        node.hidden = tag in ("head", "template") or "hidden" in attributes and attributes["hidden"].lower() in ("", "hidden") or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        nodes.append(node)
        stack.push(node)
    flush()
    return nodes


def features(nodes: list[Node]) -> list[list[float]]:
    """A row for each node."""
    for n in reversed(nodes):
        kids = n.children
        n.chars = len(n.text) + sum(k.chars for k in kids)
        n.links = n.link + sum(k.links for k in kids)
        n.stops = len(_STOPS.findall(n.text)) + sum(k.stops for k in kids)
        n.paragraphs = (n.tag == "p") + sum(k.paragraphs for k in kids)
        n.nodes = 1 + sum(k.nodes for k in kids)
        n.longest = max((k.longest for k in kids), default=len(n.text))
    total = nodes[0].chars or 1
    rows, above = [], {}
    for n in nodes:
        p = n.parent
        kind = _KINDS.get(n.tag, _OTHER)
        if p is None:
            chain = (0,) * 10
            siblings, place = [n], 0
        else:
            good, bad, talk, *tags = above[id(p)]
            k = _KINDS.get(p.tag, _OTHER)
            chain = (good + (p.good > 0), bad + (p.bad > 0), talk + (p.talk > 0), *(t or k == i for i, t in enumerate(tags)))
            siblings = p.children
            place = above[id(p), "next"]
            above[id(p), "next"] = place + 1
        above[id(n)], above[id(n), "next"] = chain, 0
        before = siblings[place - 1] if place else None
        after = siblings[place + 1] if place + 1 < len(siblings) else None
        up = p if p is not None else n
        row = [0.0] * (_OTHER + 1)
        row[kind] = 1.0
        row += [
            n.depth, n.good, n.bad, n.talk, *map(float, chain), up.good, up.bad, up.talk,
            math.log1p(n.chars), n.chars / total, n.links / (n.chars or 1), n.chars / n.nodes, n.stops / (n.chars or 1), math.log1p(n.stops), n.paragraphs, math.log1p(n.longest),
            len(siblings), place / len(siblings), n.chars / (up.chars or 1), up.links / (up.chars or 1), math.log1p(up.chars), up.paragraphs,
            before.links / (before.chars or 1) if before else -1.0, math.log1p(before.chars) if before else -1.0,
            after.links / (after.chars or 1) if after else -1.0, math.log1p(after.chars) if after else -1.0, float(_KINDS.get(up.tag, _OTHER)),
        ]
        rows.append(row)
    return rows


def decode(nodes: list[Node], odds: np.ndarray) -> list[str]:
    """The texts kept by the best labelling in which no node is kept under a dropped one.

    odds: log-odds of each node. Dropping a node is worth nothing, keeping it its odds and what is best below it.
    """
    worth, place = np.zeros(len(nodes)), {id(n): i for i, n in enumerate(nodes)}
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.hidden:
            continue
        worth[i] = max(0.0, float(odds[i]) * (math.sqrt(len(n.text)) if n.text else 1.0) + sum(worth[place[id(k)]] for k in n.children))
    kept, out = set(), []
    for i, n in enumerate(nodes):
        if n.parent is None or id(n.parent) in kept and worth[i] > 0:
            kept.add(id(n))
            if n.text:
                out.append(n.text)
    return out


_SYLLABLES = "ka lo mi ren to sha vel dor in qua est um pra bel non tir go fa lu ze".split()


def synthetic_page(rng: random.Random) -> str:
    """A page with random words around and inside an article; what belongs to the article carries data-main."""

    def words(low, high, capital=True):
        got = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(low, high + 1))]
        for i in range(len(got)):
            if rng.random() < 0.09:
                got[i] += rng.choice(",.;.")
        text = " ".join(got)
        return text.capitalize() + "." if capital else text

    def attr(*names):
        name = rng.choice(names)
        pick = rng.random()
        if pick < 0.3:
            return f' id="{name}"'
        return f' class="{name}{rng.choice(["", "", " x1", "-wrap", " box", "__inner"])}"' if pick < 0.98 else ""

    def link(low=1, high=3):
        return f'<a href="/{rng.randrange(999)}">{words(low, high, False)}</a>'

    def some(n, make, sep=""):
        return sep.join(make() for _ in range(n))

    def listed(*names):
        return f"<ul{attr(*names) if names else ''}>{some(rng.randrange(2, 9), lambda: f'<li>{link()}</li>')}</ul>"

    def paragraph(main=True):
        inner = words(1, rng.choice([3, 12, 60, 160]))
        if rng.random() < 0.25:
            inner += f" {link(1, 4)} {words(1, 20)}"
        if rng.random() < 0.15:
            inner = f"<b>{inner}" + rng.choice(["</b>", ""])
        if rng.random() < 0.1:
            inner += "<br>" + words(1, 9)
        return f"<p{' data-main' * main}>{inner}{rng.choice(['</p>', '</p>', '</p>', ''])}"

    def advert():
        tag = rng.choice(["div", "div", "aside", "section", "p"])
        return f"<{tag}{attr('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', 'ad-slot')}>{words(2, 25)}{link() if rng.random() < 0.4 else ''}</{tag}>"

    def notice():
        return f"<div{attr('cookie-notice', 'consent', 'notice', 'alert', 'gdpr', 'cookie')}><p>{words(5, 40)}</p><button>{words(1, 2, False)}</button></div>"

    def form():
        return f"<form{attr('newsletter', 'search', 'login', 'subscribe', 'signup')}><p>{words(2, 14)}</p><label>{words(1, 2, False)}</label><input name=q><button>{words(1, 1, False)}</button></form>"

    def comments():
        one = lambda: rng.choice(["<li class=comment><p>{}</p></li>", "<div class='comment'><b>{}</b><p>{}</p></div>", "<article class=comment><h4>{}</h4><p>{}</p></article>"]).replace("{}", words(1, 4), 1).replace("{}", words(3, 60))
        tag = rng.choice(["section", "div", "ol", "aside"])
        return f"<{tag}{rng.choice([' id=comments', ' class=comments', ' class=\"comment-list\"', ' id=\"disqus_thread\"', ' class=\"reader-comments\"'])}><h3>{words(1, 3)}</h3>{some(rng.randrange(1, 7), one)}{form() if rng.random() < 0.4 else ''}</{tag}>"

    def sidebar():
        tag = rng.choice(["aside", "div", "section"])
        inner = rng.choice([lambda: listed(), lambda: f"<p>{words(4, 50)}</p>", lambda: f"<h3>{words(1, 3)}</h3>{listed()}<p>{words(3, 30)}</p>", advert])()
        return f"<{tag}{attr('sidebar', 'related', 'rail', 'widget', 'trending', 'recommended')}>{inner}</{tag}>"

    def in_article():
        kind = rng.random()
        if kind < 0.7:
            return paragraph()
        if kind < 0.78:
            return f"<{(h := rng.choice(['h2', 'h3', 'h4']))} data-main>{words(1, 8)}</{h}>"
        if kind < 0.85:
            return f"<{(u := rng.choice(['ul', 'ol']))} data-main>{some(rng.randrange(2, 6), lambda: f'<li data-main>{words(1, 18)}')}</{u}>"
        if kind < 0.89:
            return f"<blockquote data-main>{paragraph() if rng.random() < 0.5 else words(4, 40)}</blockquote>"
        if kind < 0.92:
            return f"<table data-main>{some(rng.randrange(1, 4), lambda: '<tr data-main>' + some(3, lambda: f'<td data-main>{words(1, 4)}</td>') + '</tr>')}</table>"
        if kind < 0.94:
            return f"<pre data-main>{words(3, 30)}</pre>"
        return rng.choice([advert, advert, sidebar, form, lambda: f"<div{attr('share', 'social')}>{some(3, link, ' ')}</div>"])()

    tag, name = rng.choice([("article", ""), ("article", ""), ("article", attr("post", "entry", "story")), ("main", ""), ("div", attr("content", "article-body", "post-content", "entry", "main", "story-text")), ("section", attr("article", "content", "post")), ("div", ' itemprop="articleBody"')])
    title = words(1, 12)
    top = f"<h1 data-main>{title}</h1>" if rng.random() < 0.85 else ""
    if rng.random() < 0.15:
        top = f"<header><p class=byline>{words(1, 5)}</p></header>" + top
    body = some(rng.choice([1, 2, 4, 8, 16]), in_article)
    if "data-main" not in top + body:
        body += paragraph()
    end = comments() if rng.random() < 0.2 else ""
    if rng.random() < 0.1:
        end = f"<footer><p>{words(1, 12)}</p></footer>" + end
    article = f"<{tag}{name} data-main>{top}{body}{end}</{tag}>"
    for _ in range(rng.randrange(3)):
        article = f"<{(t := rng.choice(['div', 'div', 'main', 'section']))}{attr('page', 'wrap', 'container', 'row', 'layout') if rng.random() < 0.7 else ''} data-main>{sidebar() if rng.random() < 0.25 else ''}{article}{sidebar() if rng.random() < 0.25 else ''}</{t}>"
    before = [f"<nav{attr('nav', 'menu', 'topbar') if rng.random() < 0.5 else ''}>{listed()}</nav>" if rng.random() < 0.75 else f"<div{attr('menu', 'navbar', 'nav')}>{listed()}</div>"]
    if rng.random() < 0.5:
        before.append(f"<{(t := rng.choice(['header', 'div class=header', 'div id=masthead']))}><h2>{words(1, 4)}</h2>{link()}{words(2, 10)}</{t.split()[0]}>")
    before += [make() for make, odds in ((advert, 0.5), (notice, 0.25), (form, 0.2), (sidebar, 0.2)) if rng.random() < odds]
    after = [make() for make, odds in ((comments, 0.35), (sidebar, 0.3), (advert, 0.3), (notice, 0.15), (form, 0.15)) if rng.random() < odds]
    rng.shuffle(before)
    after.append(f"<{(t := rng.choice(['footer', 'footer', 'div class=footer', 'div id=foot']))}>{rng.choice(['&copy; 2020 ', '', ''])}{words(2, 22)}{link() if rng.random() < 0.4 else ''}</{t.split()[0]}>")
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"


@functools.cache
def model(pages: int = 600, seed: int = 11) -> Forest:
    """Trees over the nodes of so many synthetic pages; text is part of the article if its block is marked."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        nodes = parse(synthetic_page(rng))
        x += features(nodes)
        y += [float(n.parent is None or n.tag in ("html", "body") or (n.parent.mark if n.text else n.mark)) for n in nodes]
    return fit(np.array(x), np.array(y), trees=40, depth=5, rate=0.3, bins=16)


def main_text(pages: list[str], forest: Forest) -> list[str]:
    trees = [parse(p) for p in pages]
    rows = [r for nodes in trees for r in features(nodes)]
    odds = forest.margin(np.array(rows)) if rows else np.empty(0)
    out, at = [], 0
    for nodes in trees:
        out.append(" ".join(decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(pages: DataFrame, forest: Forest | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row: the article's blocks in page order, joined by spaces.

    Null and empty pages, and pages without an article, give an empty text. Markup is cut into tokens as the HTML
    standard says, broken or not: so a comment, a raw element or a tag that nothing ends takes the rest of the page.
    Elements close as in browsers, but misnested inline ones, which make no block, are not rebuilt. Time grows with
    the length of a page, whatever it holds. Repeated rows come back each; an empty table gives none.
    """
    forest = forest or model()

    def run(stream):
        for batch in stream:
            html, texts = batch.column("html").to_pylist(), []
            for at in range(0, len(html), 100):
                texts += main_text([h or "" for h in html[at : at + 100]], forest)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
