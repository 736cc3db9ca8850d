"""Operator 2: main text of web pages.

A page is cut into flat text blocks at block-level tags. A block's features are its word count and link density (words
within links), the same of the blocks before and after it, whether it is a heading, and two of its place: whether it is in
an article, and whether in an element that holds page furniture. A decision tree (CART, Gini impurity, numpy), trained on
the blocks of a small labelled table (labelled_pages, made by rule), classifies every block; the blocks of the main text
are joined in page order by line breaks.

Furniture is known by element (nav, aside, footer, ...) or by whole class, id and role names (sidebar, cookie-notice,
comment-list; not with-sidebar or comments-open). Names on html and body tell nothing. An article within a wrapper whose
name alone says furniture is free of it; within an element of that kind, or within comments, it is not.

Defined results: a null page counts as an empty one; without main text the text is empty and n_chars 0. Tags may be
unclosed, cut off or nested wrongly: an end tag closes the nearest open element of its name, others are ignored. Character
references are decoded within a run of text, not across tags. Rows are independent; a page of any length is worked on whole.
"""

from __future__ import annotations

import html
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from martflow.llm.shared import annotate, table

_REST = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
#: Comments; elements without text of the page (the first kind runs to the end of the page if it is not closed); tags; other markup.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|template|textarea|iframe)\b{_REST}>(?:.*?</\1\s*>|.*\Z)"
    rf"|<(noscript|select|button|head|title|canvas|audio|video)\b{_REST}>.*?</\2\s*>"
    rf"|<(/?)([a-zA-Z][\w:-]*)({_REST})>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^<>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-hidden|style|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: Elements that end the text block before them and begin another.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 "
    "h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SPACING = {"br", "img", "input", "wbr", "hr"}
FURNITURE = set("nav aside footer form menu dialog fieldset search".split())
#: Names of furniture, and of it what readers have written.
FURNITURE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline captcha consent cookie cookies copyright disclaimer "
    "foot footer form gdpr hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay paging pagination "
    "pager popup privacy promo promotion rating recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "tags teaser toc toolbar topbar warning widget widgets complementary contentinfo".split()
)
READERS = set("comment comments discussion disqus replies reply responses reviews shoutbox respond".split())
#: What may follow such a name in a longer one: comment-list, sidebar-left, share-buttons.
PARTS = set(
    "area bar block body bottom box buttons column container content footer form group header inner item items left links list main panel "
    "right row section text thread title top wrap wrapper".split()
)
#: What may not come before it: with-sidebar says what else a page has.
NOT_ITSELF = set("has have no not with without".split())
ARTICLE = {"article", "main"}
ARTICLE_NAMES = set("article articlebody body content entry main maintext post story text".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _names(value: str) -> list[list[str]]:
    """The names in a class, id or role, each by its parts."""
    return [[p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", n).lower()) if p] for n in value.split()]


def _says(name: list[str], words: set[str]) -> bool:
    """Whether a name is one of words, ends in one, or begins with one that only parts of a page follow."""
    if not name or name[0] in NOT_ITSELF:
        return False
    return name[-1] in words or name[0] in words and all(p in PARTS for p in name[1:])


def _kind(name: str, attributes: str) -> tuple[int, bool, bool]:
    """(furniture: 2 by element or readers' part, 1 by another name, 0 not; article; header) of an element."""
    furniture, article, header = 2 * (name in FURNITURE), name in ARTICLE, name == "header"
    if name in ("html", "body") or not ("=" in attributes or "hidden" in attributes):
        return furniture, article, header
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "style":
            furniture = max(furniture, 2 * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)))
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            furniture = 2
        elif key in ("class", "id", "role"):
            for n in _names(value):
                if _says(n, READERS):
                    furniture = 2
                elif _says(n, FURNITURE_NAMES):
                    furniture = max(furniture, 1)
                elif _says(n, ARTICLE_NAMES):
                    article = True
                header |= _says(n, {"header", "masthead"})
    return furniture, article, header


_cached_kind = cache(_kind)


def kind(name: str, attributes: str) -> tuple[int, bool, bool]:
    if not attributes.strip():
        return _cached_kind(name, "")
    return _kind(name, attributes)


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, is a heading, in an article, in furniture) of each text block that has a word."""
    out: list[tuple[str, int, int, bool, bool, bool]] = []
    stack: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    in_link = False
    heading = False
    at = 0

    def end_block():
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                _, furniture, article = stack[-1] if stack else ("", 0, False)
                out.append((" ".join(words), len(words), min(linked, len(words)), heading, article, furniture > 0))
            parts.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        text = html.unescape(text)
        parts.append(text)
        if in_link:
            linked += len(text.split())

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[4]
        if name is None:
            continue
        name = name.lower()
        if m[3]:  # an end tag
            if name == "a":
                in_link = False
            if name in BLOCK:
                end_block()
                if name in HEADINGS:
                    heading = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in BLOCK and stack[i][1] and parts:
                        end_block()
                    del stack[i:]
                    break
            continue
        if name == "a":
            in_link = True
        if name in SPACING:
            parts.append(" ")
        block = name in BLOCK
        if block:
            end_block()
            if stack and stack[-1][0] == "p" or stack and name == stack[-1][0] in ("li", "dt", "dd", "td", "th", "tr", "option"):
                stack.pop()
            heading = name in HEADINGS
        if name in VOID or m[5].endswith("/"):
            continue
        furniture, article, header = kind(name, m[5])
        if block or furniture:
            if not block and furniture and parts:
                end_block()
            _, around, was_article = stack[-1] if stack else ("", 0, False)
            if name in ARTICLE and not furniture and around == 1:
                around = 0  # the wrapper's name spoke of something else
            if header and not was_article:
                furniture = max(furniture, 1)
            stack.append((name, max(around, furniture), was_article or article))
    if at < len(page):
        add(page[at:])
    end_block()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """[blocks, 9]: words, link density, the same of the block before and of the one after, heading, article, furniture."""
    n = len(found)
    x = np.zeros((n, 9))
    x[:, 0] = [b[1] for b in found]
    x[:, 1] = [b[2] / b[1] for b in found]
    x[1:, 2:4] = x[:-1, :2]
    x[:-1, 4:6] = x[1:, :2]
    x[:, 6:] = [b[3:] for b in found]
    return x


class Tree:
    """CART for two classes by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 3):
        self.feature, self.limit, self.value, self.left, self.right = [], [], [], [], []
        self._grow(x, y, depth, least)
        self.arrays = [np.array(a) for a in (self.feature, self.limit, self.value, self.left, self.right)]

    def _grow(self, x, y, depth, least) -> int:
        node = len(self.feature)
        for a, v in ((self.feature, -1), (self.limit, 0.0), (self.value, y.mean()), (self.left, node), (self.right, node)):
            a.append(v)
        if depth and 0 < y.mean() < 1 and (best := self._split(x, y, least)):
            f, limit = best
            low = x[:, f] <= limit
            self.feature[node], self.limit[node] = f, limit
            self.left[node] = self._grow(x[low], y[low], depth - 1, least)
            self.right[node] = self._grow(x[~low], y[~low], depth - 1, least)
        return node

    @staticmethod
    def _split(x, y, least):
        n, best, found = len(y), y.mean() * (1 - y.mean()) - 1e-9, None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= least) & (n - k >= least)]
            if len(k):
                p, q = c[k - 1] / k, (c[-1] - c[k - 1]) / (n - k)
                g = (k * p * (1 - p) + (n - k) * q * (1 - q)) / n
                if g.min() < best:
                    i = g.argmin()
                    best, found = g[i], (f, (v[k[i]] + v[k[i] - 1]) / 2)
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, limit, value, left, right = self.arrays
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            low = x[np.arange(len(x)), feature[at]] <= limit[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return value[at] >= 0.5


#: Words of the labelled table; they carry no meaning for the tree.
_WORDS = "some words of a sentence that goes on for while as prose in an article does and has more to say about things which are here or there".split()


def _prose(rng: random.Random, least: int, most: int) -> str:
    return " ".join(rng.choices(_WORDS, k=rng.randint(least, most))).capitalize() + rng.choice([".", ".", "?", "!"])


def _links(rng: random.Random, n: int) -> list[str]:
    return [f"<a href=/{i}>{' '.join(rng.choices(_WORDS, k=rng.randint(1, 4)))}</a>" for i in range(n)]


def _menu(rng: random.Random, marked: bool) -> str:
    """A menu of links, in a form that says so or in one that does not."""
    links = _links(rng, rng.randint(5, 14))
    items = "".join(f"<li>{a}" for a in links)
    if marked:
        return rng.choice([f"<nav><ul>{items}</ul></nav>", f"<div id=menu><ul>{items}</ul></div>", f"<div class='main-nav'>{' '.join(links)}</div>"])
    return rng.choice(
        [
            f"<ul>{items}</ul>", "<table><tr>" + "".join(f"<td>{a}" for a in links) + "</table>", f"<div>{' '.join(links)}</div>",
            f"<p>{' | '.join(links)}</p>", "".join(f"<div>{a}</div>" for a in links)
        ]
    )


def _story(rng: random.Random, marked: bool) -> str:
    """The blocks of an article. Where no element says that it is one, it begins and ends with a paragraph of some length."""
    out = [f"<h1>{_prose(rng, 1, 9)}</h1>"] if rng.random() < 0.7 else []
    if marked and rng.random() < 0.25:  # a note of a line or two
        return "".join([*out, *(f"<p>{_prose(rng, 1, 9)}</p>" for _ in range(rng.randint(1, 2)))])
    for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6])):
        out.append(f"<p>{_prose(rng, 12, 110)}</p>")
        if rng.random() < 0.7 and (marked or len(out) > 1):
            a, b = _links(rng, 2)
            out.append(rng.choice([
                f"<p>{_prose(rng, 1, 8)}</p>", f"<h2>{_prose(rng, 2, 6)}</h2>", f"<p>{_prose(rng, 9, 20)} {a} {_prose(rng, 4, 9)}</p>", f"<blockquote>{_prose(rng, 5, 25)}</blockquote>",
                f"<p>See {a} and {b} for more.</p>", f"<p>{a}</p>" if marked else f"<p>More on {a}</p>", f"<ul><li>{_prose(rng, 2, 12)}<li>{_prose(rng, 2, 12)}</ul>", f"<pre>{_prose(rng, 3, 9)}</pre>",
            ]))
            out.append(f"<p>{_prose(rng, 12, 90)}</p>")
    if marked and rng.random() < 0.6:
        out.append(rng.choice([f"<p>{_prose(rng, 1, 5)}</p>", f"<p>{_links(rng, 1)[0]}</p>", f"<p>See {' '.join(_links(rng, 2))} there.</p>"]))
    return "".join(out)


def _aside(rng: random.Random, marked: bool) -> str:
    """What stands around an article: with prose of any length where a name or an element says so, else short lines."""
    if not marked:
        return rng.choice([f"<div>{_prose(rng, 2, 7)}</div>", f"<p>{_prose(rng, 2, 6)}</p><p>{_prose(rng, 2, 6)}</p>", _menu(rng, False)])
    text = f"<p>{_prose(rng, 3, 110)}</p>"
    name = rng.choice(
        [
            "class=ad", "class='sidebar'", "id=comments", "class='comment-list'", "class=cookie-notice", "class='related'", "role=banner",
            "class='newsletter box'", "class=share", "id=footer", "class='site-footer'", "class='widget'"
        ]
    )
    return rng.choice(
        [
            f"<div {name}>{text}</div>", f"<section {name}>{text}{text}</section>", f"<aside>{text}</aside>", f"<footer>{text}</footer>",
            f"<form>{text}<p>Your name</p></form>", f"<div {name}>{_menu(rng, False)}</div>"
        ]
    )


#: The elements around the articles of the labelled table; half of them say nothing.
FORMS = ("article", "", "main", "", "div class=post", "", "div id=content", "", "div class='entry-content has-ads'", "")


def labelled_pages(pages: int, seed: int, forms: tuple[str, ...] = FORMS) -> list[list[tuple[str, int]]]:
    """The labelled table: pages as runs of (HTML, whether its blocks are main text). A form is the element around the article."""
    rng, out = random.Random(seed), []
    for i in range(pages):
        form = forms[i % len(forms)]
        marked = rng.random() < 0.5
        if rng.random() < 0.25:  # an article and nothing else
            out.append([(f"<{form}>", 0)] * bool(form) + [(_story(rng, bool(form)), 1)])
            continue
        page = [("<body" + rng.choice(["", " class='single post with-sidebar'", " class='home comments-open'", " id=page"]) + ">", 0), (_menu(rng, marked), 0)]
        page += [
            (
                rng.choice([f"<header><a href=/>{_prose(rng, 1, 3)}</a> {_prose(rng, 2, 8)}</header>", _menu(rng, False), _aside(rng, True)]),
                0
            ) for _ in range(rng.randint(0, 2))
        ]
        if form:
            inner = [(_story(rng, True), 1)]
            if rng.random() < 0.5:
                inner += [(_aside(rng, True), 0), (_story(rng, True), 1)]
            page += [(f"<{form}>", 0), *inner, (f"</{form.split()[0]}>", 0)]
        else:
            page += [(rng.choice(["", "<div><div>"]), 0), (_story(rng, False), 1), ("</div></div>", 0)]
        page += [(_aside(rng, marked or rng.random() < 0.5), 0) for _ in range(rng.choice([0, 0, 1, 2, 3]))]
        out.append(page)
    return out


def labelled_blocks(pages: list[list[tuple[str, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    xs, ys = [], []
    for page in pages:
        # a mark of private use at the start of every text of a run tells which run a block came from
        found = blocks("".join(re.sub(r"(?<=>)(?=[^<])", chr(0xE000), run) if label else run for run, label in page))
        ys += [chr(0xE000) in b[0] for b in found]
        xs.append(features(found))
    return np.concatenate(xs), np.array(ys, float)


@cache
def trained() -> Tree:
    """The tree of the labelled table."""
    return Tree(*labelled_blocks(labelled_pages(200, 17)))


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b[0] for b, main in zip(found, trained().predict(features(found))) if main)


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """df with text, the main text of each page, and n_chars, its code points."""

    def make(col: pa.Array):
        texts = [main_text(x) for i in range(0, len(col), 256) for x in col.slice(i, 256).to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return annotate(df, column, [("text", "string"), ("n_chars", "long")], make)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
