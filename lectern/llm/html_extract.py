"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of tags and runs of words. Tags score negative, and words score by where they stand: the sum of the weights of the elements around them. An
element's features are its tag and the words of its class, id and role, each together with what the element holds: a small part of the page's words, most of them, or a whole
article or main element; names count by their parts of four letters as well, so that commentlist is like comments. Where a page has an article or main element with half of its words, standing beside it is a feature, and
a link counts by what the block around it holds and whether blocks of text are its neighbours. All weights are learned from labelled pages by logistic regression; no name decides by itself, so a wrapper called has-sidebar, a form around
a page or an article called "post share" keep their text. One linear scan finds the contiguous region with the largest score. Of the blocks in the region, those whose own
words score negative (an advert or a form amid the article) are left out.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_bytes, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCKS = frozenset("html head body title p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article header footer nav aside main form fieldset blockquote pre hr figure figcaption address details summary menu dialog button label option legend center".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end where another of their kind begins, and those that keep them apart.
SELF_CLOSING, KEEP_APART = frozenset("p li tr td th dt dd option".split()), ("ul", "ol", "table", "div", "section", "article", "dl")
CONTENT_TAGS = frozenset(("article", "main"))
#: Elements within a line, which tell nothing about the block.
INLINE = frozenset("a abbr b big bdi cite code em font i kbd mark q s small span strong sub sup time u var".split())
#: A name that begins so or holds such a word tells from there on what stands beside the text or in it: has-sidebar, page-with-nav. Such words are features of their own.
BESIDE = frozenset("has no not with without".split())
#: Names that the boxes of the labelled pages have, and those of them that wrappers around a main text have as well.
BOX_NAMES = "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup disclaimer legal nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related recommended share sharing social toolbar footer masthead topbar comment comments discussion replies respond reply disqus login search skip pagination pager contentinfo complementary".split()
WRAPPER_NAMES = "banner footer login masthead menu nav navbar navigation notice notices overlay pager pagination search share sharing sidebar skip social toolbar topbar widget".split()
#: Letters of the parts of a name.
GRAM = 4
#: Blocks that are part of a larger one around them.
PARTS = frozenset("p li ul ol dl dt dd td th tr tbody thead tfoot table".split())
#: Blocks of a running text.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
#: What an element holds.
SMALL, MOST, ARTICLE = 0, 1, 2


@lru_cache(maxsize=20_000)
def features(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's tag and the words of its class, id and role, in lower case; body and html tell nothing."""
    if tag in ("body", "html"):
        return ()
    found = set() if tag in INLINE else {f"<{tag}>"}
    for x in NAMED.findall(attributes) if attributes else ():
        for name in "".join(x).split():
            words = [w.lower() for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if w]
            stop = next((i for i, w in enumerate(words) if w in BESIDE), len(words))
            found.update(words[:stop], (f"beside {w}" for w in words[stop + 1 :]))
    return tuple(sorted(found))


@lru_cache(maxsize=20_000)
def grams(name: str) -> tuple[str, ...]:
    """The parts of a name, by which one counts that no labelled page has; a tag, and what a name says of its neighbours, has none."""
    return () if name[0] == "<" or " " in name else tuple({f"~{name[i : i + GRAM]}" for i in range(len(name) - GRAM + 1)})


class Element:
    """An open element: what names it, what it stands in, how many words outside links it holds, and whether an article or main element with half of the page's words lies in it, whether it lies in such an element, and the blocks before and after it under the same element."""

    __slots__ = ("tag", "names", "up", "words", "article", "within", "before", "after", "link", "holder", "score", "held")

    def __init__(self, tag: str, names: tuple[str, ...], up: Element | None):
        self.tag, self.names, self.up, self.words, self.article, self.within = tag, names, up, 0, False, False
        self.before = self.after = None
        self.link = tag == "a" or bool(up and up.link)
        self.holder = self if tag in BLOCKS or not up else up.holder
        self.score, self.held = 0.0, SMALL


    def of_link(self) -> tuple[tuple[str, object], ...]:
        """What words in a link count by: the block they stand in, whether it holds other words, and how many of its neighbours (or of those of the list or table it is part of) are blocks of text."""
        box = self.holder
        while box.up and box.up.tag in PARTS:
            box = box.up
        amid = ("link", sum(x is not None and x.tag in TEXT and x.words >= 3 for x in (box.before, box.after)), box.within)
        return ("link", self.holder.tag), ("link", self.holder.words > 0), amid, (*amid, self.holder.tag)


def scan(page: str) -> tuple[list[tuple[str, str, int, Element]], list[Element]]:
    """The tokens ("tag" or "text", tag name or raw text, position, innermost open element) and the elements, outer ones first. Linear in the page, however deep its elements lie."""
    root = Element("", (), None)
    stack, every, found, at = [root], [root], [], 0
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    blocks: list[int] = []

    def cut(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCKS:
                blocks.pop()

    for m in TOKEN.finditer(page):
        if m.start() > at:
            found.append(("text", page[at : m.start()], at, stack[-1]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1]:
                found.append(("tag", m[1].lower(), m.start(), stack[-1]))
            continue
        found.append(("tag", tag, m.start(), stack[-1]))
        own = places.setdefault(tag, [])
        if m[2]:
            # A stray end tag of a small element doesn't close a container around it.
            if own and (tag in BLOCKS or not blocks or blocks[-1] < own[-1]):
                cut(own[-1])
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            if tag in SELF_CLOSING and own and all(not places.get(t) or places[t][-1] <= own[-1] for t in KEEP_APART):
                cut(own[-1])
            own.append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append(Element(tag, (features if len(m[4]) <= 2000 else features.__wrapped__)(tag, m[4]), stack[-1]))
            every.append(stack[-1])
    if at < len(page):
        found.append(("text", page[at:], at, stack[-1]))
    for kind, value, _, element in found:
        if kind == "text" and not element.link:
            element.words += len(value.split())
    for e in reversed(every):
        if e.up:
            e.up.words += e.words
    youngest: dict[int, Element] = {}
    for e in every:
        if e.up and e.tag in BLOCKS:
            e.before = youngest.get(id(e.up))
            if e.before:
                e.before.after = e
            youngest[id(e.up)] = e
    half = root.words / 2
    for e in reversed(every):
        e.article = e.article or e.tag in CONTENT_TAGS and e.words >= half and e.words > 0
        e.held = ARTICLE if e.article else MOST if e.words > half else SMALL
        if e.up:
            e.up.article = e.up.article or e.article
    for e in every:
        e.within = bool(e.up and e.up.within) or e.tag in CONTENT_TAGS and e.article
        if root.article and not e.within and not e.article and e.up and (e.up.article or e.up is root):
            e.names = (*e.names, "beside an article")
    return found, every


def labelled_pages(n: int = 60, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Labelled pages: page and the spans of its main text. They are invented from common page layouts, as no table holds labels for pages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ta", "re", "mi", "son", "lu", "ke", "par")) for _ in range(rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    links = lambda: "".join(f'<li><a href="/{word()}">{some(1, 3)}</a></li>' for _ in range(rng.randint(3, 9)))
    chrome = [
        lambda: f"<nav><ul>{links()}</ul></nav>", lambda: f"<header><a href='/'>{some(1, 4)}</a><p>{some(2, 6)}</p></header>",
        lambda: f'<div class="ad">{some(4, 20)}</div>', lambda: f'<div id="cookie-notice"><p>{some(8, 25)}</p><button>{word()}</button></div>',
        lambda: f'<aside class="sidebar"><h3>{some(1, 3)}</h3><ul>{links()}</ul></aside>', lambda: f'<form action="/s"><label>{some(1, 3)}</label><input name="q"></form>',
        lambda: f'<div class="breadcrumb">{links()}</div>', lambda: f'<section class="comments"><h2>{some(1, 2)}</h2>' + "".join(f"<div><b>{word()}</b><p>{some(5, 40)}</p></div>" for _ in range(rng.randint(1, 5))) + "</section>",
        lambda: f"<footer><p>&copy; {some(3, 12)}</p><ul>{links()}</ul></footer>", lambda: f"<ul>{links()}</ul>", lambda: f"<div><a href='#'>{some(1, 3)}</a></div>",
    ]
    holders = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<div>", "</div>"), ('<section id="story">', "</section>")]
    pages = []
    for _ in range(n):
        parts, spans = [f"<html><head><title>{some(2, 8)}</title><style>p{{}}</style></head><body>"], []
        parts += [rng.choice(chrome)() for _ in range(rng.randint(1, 5))]
        a, b = rng.choice(holders)
        parts.append(a)
        for text in [f"<h1>{some(2, 10)}</h1>", *(f"<p>{some(5, 120)}</p>" for _ in range(rng.randint(2, 12)))]:
            at = sum(map(len, parts))
            spans.append((at, at + len(text)))
            parts.append(text)
            if rng.random() < 0.1:
                parts.append(f'<div class="ad">{some(4, 12)}</div>')
        parts.append(b)
        parts += [rng.choice(chrome)() for _ in range(rng.randint(1, 4))]
        pages.append(("".join(parts), spans))
    return pages


def varied_pages(n: int = 60, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Labelled pages of harder layouts: wrappers and articles with the names of boxes, boxes amid the article, and large boxes beside a short article or none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ta", "re", "mi", "son", "lu", "ke", "par")) for _ in range(rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    links = lambda: "".join(f'<li><a href="/{word()}">{some(1, 3)}</a></li>' for _ in range(rng.randint(3, 9)))
    chrome = [
        lambda: f"<nav><ul>{links()}</ul></nav>", lambda: f"<header><a href='/'>{some(1, 4)}</a><p>{some(2, 6)}</p></header>",
        lambda: f'<div class="ad">{some(4, 20)}</div>', lambda: f'<div id="cookie-notice"><p>{some(8, 25)}</p><button>{word()}</button></div>',
        lambda: f'<aside class="sidebar"><h3>{some(1, 3)}</h3><ul>{links()}</ul></aside>', lambda: f'<form action="/s"><label>{some(1, 4)}</label><input name="q"></form>',
        lambda: f'<div class="breadcrumb">{links()}</div>', lambda: f'<section class="comments"><h2>{some(1, 2)}</h2>' + "".join(f"<div><b>{word()}</b><p>{some(5, 40)}</p></div>" for _ in range(rng.randint(1, 5))) + "</section>",
        lambda: f"<footer><p>&copy; {some(3, 12)}</p><ul>{links()}</ul></footer>", lambda: f"<ul>{links()}</ul>", lambda: f"<div><a href='#'>{some(1, 3)}</a></div>",
        lambda: f'<{(t := rng.choice(("div", "div", "section", "ul")))} {rng.choice(("class", "id"))}="{rng.choice(BOX_NAMES)}{rng.choice(("", "-box", "-area"))}"><p>{some(3, 40)}</p></{t}>',
        lambda: f'<{(t := rng.choice(("nav", "aside", "footer", "menu", "dialog")))}><p>{some(3, 40)}</p></{t}>', lambda: f"<{(t := rng.choice(('button', 'label', 'option', 'legend')))}>{some(1, 4)}</{t}>",
    ]
    plain = [("<div>", "</div>"), ('<div class="content">', "</div>"), ('<section id="story">', "</section>"), ("", ""), ('<div><div class="body">', "</div></div>"), ('<div class="page"><div>', "</div></div>"), ("<div><div>", "</div></div>")]
    large = [  # boxes with most words of the page beside a short article or none
        lambda: f'<section class="{rng.choice(BOX_NAMES)}">' + "".join(f"<p>{some(30, 60)}</p>" for _ in range(6)) + "</section>",
        lambda: f'<div class="{rng.choice([x for x in BOX_NAMES if x not in WRAPPER_NAMES])}">' + "".join(f"<div><b>{word()}</b><p>{some(30, 60)}</p></div>" for _ in range(6)) + "</div>",
        lambda: f'<div class="{rng.choice([x for x in BOX_NAMES if x not in WRAPPER_NAMES])}"><div>' + "".join(f"<p>{some(30, 60)}</p>" for _ in range(rng.choice((1, 6)))) + "</div></div>",
        lambda: f"<{(t := rng.choice(('nav', 'aside', 'footer', 'menu', 'dialog')))}>" + "".join(f"<p>{some(30, 60)}</p>" for _ in range(6)) + f"</{t}>",
    ]
    inline = lambda: f" <{(t := rng.choice(('b', 'i', 'em', 'strong', 'span', 'code')))}>{some(1, 6)}</{t}> "
    body = [  # blocks of a main text
        *[lambda t: f"<{t}>{some(5, 120)}</{t}>"] * 6, lambda t: f"<{t}>{some(3, 30)}{inline()}{some(3, 30)}</{t}>", lambda t: f"<{t}>{some(3, 30)} <a href='/{word()}'>{some(1, 3)}</a> {some(3, 30)}</{t}>",
        lambda t: f"<{t}>{some(3, 30)}<br>{some(3, 30)}</{t}>", lambda t: "<ul>" + "".join(f"<li>{some(4, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>", lambda t: f"<blockquote>{some(6, 40)}</blockquote>",
        lambda t: f"<h2>{some(2, 6)}</h2>", lambda t: f"<{t}><a href='/{word()}'>{some(3, 12)}</a></{t}>", lambda t: "<ul>" + "".join(f"<li><a href='/{word()}'>{some(1, 8)}</a></li>" for _ in range(rng.randint(1, 5))) + "</ul>", lambda t: "<table>" + "".join(f"<tr><td>{some(2, 6)}</td><td>{some(2, 6)}</td></tr>" for _ in range(3)) + "</table>", lambda t: f"<{t}>{some(1, 4)}</{t}>",
    ]
    beside = lambda: f"{rng.choice(('has', 'with', 'no', 'page-with', 'without'))}-{rng.choice(BOX_NAMES)}"
    unknown = lambda: word() + word()
    odd = lambda: f'<{(t := rng.choice(("div", "ol", "section")))} class="{unknown()}"><p>{some(3, 40)}</p></{t}>'
    pages = []
    for i in range(n):
        parts, spans = [f"<html><head><title>{some(2, 8)}</title><style>p{{}}</style></head><body>"], []
        kind = i % 7  # 0 to 2: an article or main element, wrapped or named in any way; 3 and 4: a plain holder, wrapped at times; 5 and 6: a large box beside a short article or none
        wraps = []
        if kind < 3:
            t = rng.choice(("article", "main"))
            wraps.append((f'<{t} class="{rng.choice((*BOX_NAMES, "post", "entry", "post", "entry"))}">' if rng.random() < 0.5 else f"<{t}>", f"</{t}>"))
            if rng.random() < 0.3:
                wraps.insert(0, (f'<main class="{rng.choice(BOX_NAMES)}">' if rng.random() < 0.5 else "<main>", "</main>"))
        elif kind < 5:
            wraps.append(rng.choice(plain))
        if kind < 5 and rng.random() < 0.5:
            names = rng.choice(BOX_NAMES if kind < 3 else WRAPPER_NAMES)
            wraps.insert(0, rng.choice([(f'<div class="{beside()}">', "</div>"), (f'<div class="{unknown()}">', "</div>"), (f'<div class="{names}">', "</div>"), (f'<section id="{names}-page">', "</section>"), (rng.choice(('<form id="page" action="/">', '<form method="post">')), "</form>")]))
        around = chrome + [odd] * 2 if kind < 3 else chrome  # a box that nothing names is told by the article beside it
        parts += [rng.choice(around)() for _ in range(rng.randint(1, 5))]
        if kind >= 5:
            if rng.random() < 0.6:
                parts.append("<article><p>")
                text = some(20, 80)
                spans.append((sum(map(len, parts)), sum(map(len, parts)) + len(text)))
                parts += [text, "</p></article>"]
            parts.append(rng.choice(large)())
        else:
            parts += [a for a, _ in wraps]
            style = "div" if rng.random() < 0.25 else "p"
            for text in [f"<h1>{some(2, 10)}</h1>" if rng.random() < 0.8 else f"<h2>{some(2, 10)}</h2>", *(rng.choice(body)(style) for _ in range(rng.randint(2, 12)))]:
                at = sum(map(len, parts))
                spans.append((at, at + len(text)))
                parts.append(text)
                if rng.random() < 0.3:
                    name, text = rng.choice(BOX_NAMES), some(2, 12)
                    parts.append(rng.choice((f'<div class="{name}">{text}</div>', f'<div class="{name}"><p>{text}</p></div>', f'<section id="{name}"><div><p>{text}</p></div></section>', f'<div class="with-{name}">{text}</div>')))
            parts += [b for _, b in reversed(wraps)]
        parts += [rng.choice(around)() for _ in range(rng.randint(1, 4))]
        pages.append(("".join(parts), spans))
    return pages


#: What a tag takes at most, and one that no labelled page has; the bounds of a word's score in the scan. Negative words stand between tags that count as well, so one takes less than a positive one gives.
MOST_OF_TAG, OTHER_TAG, LOW, HIGH = 0.3, -0.3, -0.1, 2.0
#: Labelled pages to learn from, passes of the regression, and its penalty.
PAGES, STEPS, PENALTY = 1600, 800, 1e-5
#: What words count less by in a block that holds nothing but links: more is asked of it than of text.
DOUBT = 3.0
#: A name that so many elements of the labelled pages have is known and counts as itself, another one by its parts.
KNOWN = 3


@lru_cache(maxsize=1)
def weights() -> tuple[dict[str, float], dict[tuple[str, object], float], float]:
    """(tags, features, constant). A tag's weight follows the log odds of its places inside against outside the main text and is always negative; words score by features of the elements around them."""
    tags, index, rows = (Counter(), Counter()), {}, {}
    pages = [(scan(page), spans) for page, spans in labelled_pages(PAGES // 4) + varied_pages(PAGES)]
    often = Counter(x for (_, every), _ in pages for e in every for x in e.names)
    for (found, _), spans in pages:
        bounds = np.array(spans, np.int64).reshape(-1, 2)
        for kind, value, at, element in found:
            k = int(np.searchsorted(bounds[:, 0], at, side="right")) - 1
            inside = k >= 0 and bool(at < bounds[k, 1])
            if kind == "tag":
                tags[inside][value] += 1
            elif n := len(value.split()):
                own = {index.setdefault(x, len(index)) for x in element.of_link()} if element.link else set()
                alike = set(own)  # the same place as if no name were known
                e = element
                while e is not None:
                    for x in e.names:
                        parts = {index.setdefault((g, e.held), len(index)) for g in grams(x)}
                        alike |= parts
                        own |= {index.setdefault((x, e.held), len(index))} if often[x] >= KNOWN else parts
                        if not grams(x):
                            alike.add(index.setdefault((x, e.held), len(index)))
                    e = e.up
                for key in {(frozenset(own), inside), (frozenset(alike), inside)}:
                    rows[key] = rows.get(key, 0) + n
    n = len(index)  # also the number of the padding, whose weight stays zero
    width = max(len(own) for own, _ in rows)
    x = np.array([[*own, *[n] * (width - len(own))] for own, _ in rows])
    y, weight = np.array([inside for _, inside in rows], float), np.log1p(np.array(list(rows.values()), float))  # so that rare places count as well
    weight /= weight.sum()
    w, b, speed, fall = np.zeros(n + 1), 0.0, np.full(n + 1, 1e-6), 1e-6
    for _ in range(STEPS):
        g = (1 / (1 + np.exp(-np.clip(w[x].sum(axis=1) + b, -30, 30))) - y) * weight
        gw, gb = np.bincount(x.ravel(), np.repeat(g, width), n + 1) + PENALTY * w, float(g.sum())
        gw[n] = 0
        speed, fall = speed + gw * gw, fall + gb * gb
        w, b = w - 0.7 * gw / np.sqrt(speed), b - 0.7 * gb / math.sqrt(fall)
    odds = {t: math.log((tags[True][t] + 1) / (tags[False][t] + 1)) for t in {*tags[True], *tags[False]}}
    learned = {name: float(w[i]) for name, i in index.items()}
    for x in [x for x in often if often[x] >= KNOWN]:  # known, but not in this place
        learned |= {(x, held): 0.0 for held in (SMALL, MOST, ARTICLE) if (x, held) not in learned and not grams(x)}
    return {t: -min(MOST_OF_TAG, math.log1p(math.exp(-v))) for t, v in odds.items()}, learned, b


def main_text(page: str | None, model: tuple | None = None) -> str:
    """The main text of a page: its blocks, white space turned into one space and trimmed, joined by line feeds; empty where there is none."""
    if not page:
        return ""
    tags, learned, constant = model or weights()
    found, every = scan(page)
    for e in every:
        e.score = (e.up.score if e.up else constant) + sum(learned[x, e.held] if (x, e.held) in learned else sum(learned.get((g, e.held), 0.0) for g in grams(x)) for x in e.names)
    blocks: list[list] = []  # text, score of its words, numbers of the first and last token
    run: list[str] = []
    scores: list[float] = []
    begun, own = 0, 0.0

    def close() -> None:
        nonlocal own
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                blocks.append([text, own, begun, len(scores)])
            run.clear()
        own = 0.0

    for kind, value, _, element in found:
        if kind == "tag":
            if value in BLOCKS:
                close()
            elif value == "br":
                run.append(" ")
            scores.append(tags.get(value, OTHER_TAG))
        else:
            if not run:
                begun = len(scores)
            run.append(value)
            n, score = len(value.split()), element.score
            if element.link:
                score += sum(learned.get(x, 0.0) for x in element.of_link()) - (0.0 if element.holder.words else DOUBT)
            scores.append(min(HIGH, max(LOW, score)) * n)
            own += min(HIGH, max(-HIGH, score)) * n
    close()
    best = total = 0.0
    first = start = last = 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, last = total, start, i + 1
    return "\n".join(b[0] for b in blocks if b[1] > 0 and b[2] < last and b[3] > first) if best > 0 else ""


def extract(pages: DataFrame, html_col: str = "html", batch_bytes: int = 4 << 20) -> DataFrame:
    """pages with the column html replaced by text and n_chars (code points), a row for each row of pages.

    A null or empty page, or one without main text, has an empty text. Columns called text or n_chars are replaced. Repeated rows stay.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    rows = pages.select(*kept, html_col)
    schema = pages.select(kept).schema.add("text", "string").add("n_chars", "long")
    model = weights()  # learned once; some hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, html_col, batch_bytes):
            found = [main_text(x.as_py(), model) for x in batch.column(html_col)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*kept, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for all pages."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: For pages whose main text is an article element of headings and paragraphs, as in the given tables.
OP10_SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS l FROM a),
c AS (SELECT page_id, url, list_transform(l, lambda x: trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '&amp', '&'), '\\s+', ' ', 'g'))) AS l FROM b)
SELECT page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(l, lambda x: x <> ''), chr(10))) AS n_chars FROM c
"""
