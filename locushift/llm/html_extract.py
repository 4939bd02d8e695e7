"""HTML extraction by maximum-scoring subsequence.

A page becomes a row of tokens: the words of each piece of text and the tags between them. A word's score is the
log odds that its surroundings (open elements, the words of their class, id and role, and whether the page's article
or main element is closed) hold main text; a tag's score is negative, by how much rarer it is inside main text. One
linear scan finds the contiguous run of tokens with the largest sum; the pieces of that run whose place does not speak
against them are the text. The weights are learned once, by logistic regression in numpy, from labelled pages that
``labelled_pages`` lays out (the tables have no labels for pages); names that fewer than three of them have count for
nothing.

Defined results: null and empty pages give an empty text; content of scripts, styles and the head is never text; an
unclosed tag or comment at the end is dropped; unknown or misnested end tags are ignored; a page of which no run scores
above 0 keeps what no place speaks against; white space is what Python calls so; equal rows give equal results; an empty
table gives an empty result; extra columns are ignored. A page without any tags is one block of main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import slices, texts_of
from .common import small_batches

#: HTML's void elements, elements whose content is never text of the page, those with markup of their own, and
#: elements that stay within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea select title".split())
FOREIGN_MARKUP = ("math", "svg")
INLINE = frozenset("a abbr audio canvas iframe math noscript object svg video acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Elements that end an open paragraph, and elements that end an open one of their own kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TAG = re.compile(r"""</?([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_HINT = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Open:
    """The open elements: where each name lies on the stack, and the sum of the weights of the distinct names and hints.

    Weights are whole numbers, so that the sum stays exact however often names come and go; a step costs the same at
    any depth.
    """

    def __init__(self, weights: dict[str, int] | None = None, has_main: bool = False):
        self.weights, self.has_main = weights or {}, has_main
        self.stack: list[tuple[str, ...]] = []
        self.places: dict[str, list[int]] = {}
        self.names: dict[str, int] = {}
        self.total = 0

    def push(self, name: str, hints: list[str]) -> None:
        own = (name, *("." + h for h in hints))
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(own)
        for x in own:
            k = self.names.get(x, 0)
            if not k:
                self.total += self.weights.get(x, 0)
            self.names[x] = k + 1

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names; -1 if none is open."""
        return max((p[-1] for p in map(self.places.get, names) if p), default=-1)

    def cut(self, depth: int) -> None:
        """Closes all elements from ``depth`` on."""
        while len(self.stack) > depth:
            own = self.stack.pop()
            self.places[own[0]].pop()
            for x in own:
                self.names[x] -= 1
                if not self.names[x]:
                    del self.names[x]
                    self.total -= self.weights.get(x, 0)

    def outside(self) -> bool:
        """Whether the page has an element for its main text that is not open."""
        return self.has_main and self.last("article", "main") < 0

    def context(self) -> tuple[str, ...]:
        return (*sorted(self.names), *(["~outside"] if self.outside() else []))


_HAS_MAIN = re.compile(r"<(?:article|main)[\s>]", re.I)


def pieces(page: str, open_: Open) -> Iterator[tuple[str, str]]:
    """("text", text) and ("tag", name) in page order; ``open_`` has the elements open at a text."""
    at = 0
    n = len(page)
    while at < n:
        opened = page.find("<", at)
        if opened < 0:
            yield "text", page[at:]
            return
        if opened > at:
            yield "text", page[at:opened]
        if page.startswith("<!--", opened):
            end = page.find("-->", opened + 4)
            at = end + 3 if end >= 0 else n
            continue
        after = page[opened + 1 : opened + 2]
        if after in ("!", "?"):
            end = page.find(">", opened)
            at = end + 1 if end >= 0 else n
            continue
        m = _TAG.match(page, opened)
        if not m:
            if after.isalpha() or after == "/":
                end = page.find(">", opened)
                at = end + 1 if end >= 0 else n
            else:
                yield "text", "<"
                at = opened + 1
            continue
        at, name = m.end(), m[1].lower()
        if page[opened + 1] == "/":
            if (depth := open_.last(name)) >= 0:
                open_.cut(depth)
                yield "tag", name
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            yield "tag", name
            continue
        if name in VOID:
            yield "tag", name
            continue
        if name in ENDS_P:
            if (depth := open_.last("p")) >= 0:
                open_.cut(depth)
        elif name in ENDS_OWN:
            depth = open_.last(name)
            if depth > open_.last(*ENDS_OWN[name]):
                open_.cut(depth)
        open_.push(name, [p.lower() for h in _HINT.findall(m[2]) for p in _PART.findall("".join(h[1:]))])
        yield "tag", name


# --- labelled pages -----------------------------------------------------------------------------------------------

#: Usual names of page parts that hold main text, and of parts that do not.
MAIN = ("article", "main", "div.content", "div.post", "div.entry-content", "section.story", "div#article-body", "div.post-body", "main.content", "section.text", "article.post")
PARTS = (
    "nav", "nav.menu", "ul.nav", "div.navbar", "div.menu", "header", "div.header", "div#masthead", "div.topbar", "footer", "div.footer", "div.copyright", "aside", "aside.sidebar", "div.sidebar",
    "div.widget", "div.related", "div.recommended", "div.more-stories", "div.ad", "div.ads", "div.advert", "div.advertisement", "section.promo", "div.sponsored", "div.banner", "div.cookie-notice",
    "div.consent", "div.notice", "p.notice", "div.alert", "div.popup", "div.modal", "div.disclaimer", "div.newsletter", "form", "form.search", "form.login", "div.subscribe", "div.share", "div.social", "ul.share",
    "div.breadcrumbs", "div.pagination", "div.comments", "section#comments", "div.comment", "ol.comment-list", "div.reply", "div.respond", "div.discussion", "div.tags", "div.byline", "div.meta", "button", "div.toolbar", "div.legal",
    "div.box", "div.panel", "div.poll", "div.events", "div.ticker", "div.weather", "div.links", "div.gallery",
)
WORDS = "the of and a to in is was for on with as by at from this that which one two new old time year people work first last".split()


def _made_up(rng: np.random.Generator) -> str:
    """A class name that says nothing."""
    return "".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 3)) + str(rng.integers(10))


def _open_close(part: str) -> tuple[str, str]:
    name, kind, hint = re.match(r"(\w+)([.#]?)(.*)", part).groups()
    attr = {".": f' class="{hint}"', "#": f' id="{hint}"', "": ""}[kind]
    return f"<{name}{attr}>", f"</{name}>"


def labelled_pages(n: int = 400, seed: int = 5) -> list[str]:
    """Pages with their main words written in capitals, all others in small letters."""
    rng = np.random.default_rng(seed)

    def some(a: int, b: int) -> str:
        return " ".join(rng.choice(WORDS, rng.integers(a, b)))

    def part(name: str | None) -> str:
        a, b = _open_close(name or f"div.{_made_up(rng)}")
        if name is None:  # a name that says nothing: links, or a few words
            name, kind = "div", rng.choice([0, 0, 3])
            if kind:
                return a + f"<p>{some(1, 7)}</p>" * rng.integers(1, 3) + b
        kind = rng.integers(4)
        if name.startswith(("ul", "ol")) or kind == 0:
            items = "".join(f"<li><a href='#'>{some(1, 4)}</a></li>" for _ in range(rng.integers(2, 7)))
            return a + (items if name.startswith(("ul", "ol")) else f"<ul>{items}</ul>") + b
        if kind == 1:
            return a + f"<h3>{some(1, 5)}</h3><p>{some(5, 60)}</p>" + b
        if kind == 2:
            return a + "".join(f"<p>{some(3, 40)}</p>" for _ in range(rng.integers(1, 4))) + b
        return a + some(2, 30) + b

    def body() -> str:
        out = [f"<h1>{some(2, 9).upper()}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.integers(2, 12)):
            kind, text = rng.integers(12), some(1, 90).upper()
            if kind == 0:
                level = rng.integers(2, 5)
                out.append(f"<h{level}>{some(1, 6).upper()}</h{level}>")
            elif kind == 1:
                name = ("ul", "ol")[rng.integers(2)]
                out.append(f"<{name}>" + "".join(f"<li>{some(1, 15).upper()}</li>" for _ in range(rng.integers(1, 5))) + f"</{name}>")
            elif kind == 2:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind == 3:
                out.append(f"<table><tr><td>{some(1, 4).upper()}</td><td>{some(1, 4).upper()}</td></tr></table>")
            elif kind == 4:
                out.append(f"<p>{text} <a href='#'>{some(1, 4).upper()}</a> <b>{some(1, 3).upper()}</b></p>")
            elif kind == 5:
                out.append(f"<pre>{text}</pre>")
            elif kind == 6 and rng.random() < 0.6:
                out.append(part(PARTS[rng.integers(len(PARTS))]))
            elif kind == 7:
                out.append(f"<div>{text}</div>")
            else:
                out.append(f"<p>{text}</p>")
        return "".join(out)

    pages = []
    for _ in range(n):
        a, b = _open_close(MAIN[rng.integers(len(MAIN))] if rng.random() < 0.6 else f"div.{_made_up(rng)}")
        picked = [PARTS[i] for i in rng.permutation(len(PARTS))[: rng.integers(3, 10)]]
        if rng.random() < 0.5:
            picked[rng.integers(len(picked))] = None
        cut = rng.integers(1, len(picked))
        before, after = ("".join(part(x) for x in own) for own in (picked[:cut], picked[cut:]))
        main = (a + body() + b, body(), "<div>" + body() + "</div>")[max(0, rng.integers(8) - 5)]
        if rng.random() < 0.3:
            main = f"<div class='{rng.choice(['wrapper', _made_up(rng)])}'>{main}</div>"
        pages.append(f"<html><head><title>x</title></head><body>{before}{main}{after}</body></html>")
    return pages


#: Weights are counted in parts of SCALE. Pieces of fewer words than SHORT, and of LONG words or more, have features of their own.
SCALE, SHORT, LONG = 1 << 20, 8, 20


def size_of(n: int) -> str | None:
    return "~short" if n < SHORT else "~long" if n >= LONG else None


class Model(NamedTuple):
    names: dict[str, int]  # by element name, hint or feature
    base: int
    tags: dict[str, float]

    def word_score(self, open_: Open) -> float:
        """Log odds that a word in this context is main text; a page without tags is main text."""
        if not open_.stack:
            return 0.5
        total = self.base + open_.total + (self.names.get("~outside", 0) if open_.outside() else 0)
        return max(-4.0, min(4.0, total / SCALE))


def fitted(pages: list[str]) -> Model:
    """Logistic regression over the contexts of labelled texts (capitals are main text), and log ratios of the tags."""
    seen: dict[tuple[str, ...], list[int]] = {}
    tags: dict[str, list[int]] = {}
    on_pages: Counter[str] = Counter()
    for page in pages:
        own = set()
        main = False
        open_ = Open(has_main=bool(_HAS_MAIN.search(page)))
        for kind, value in pieces(page, open_):
            if kind == "text" and value.strip():
                main = value.isupper()
                context = (*open_.context(), *([size] if (size := size_of(len(value.split()))) else []))
                own.update(context)
                seen.setdefault(context, [0, 0])[0 if main else 1] += len(value.split())
            elif kind == "tag":
                tags.setdefault(value, [0, 0])[0 if main else 1] += 1
        on_pages.update(own)
    names = {x: i for i, x in enumerate(sorted(x for x, k in on_pages.items() if k > 2))}
    x = np.zeros((len(seen), len(names)))
    for i, r in enumerate(seen):
        x[i, [names[v] for v in r if v in names]] = 1
    k = np.array(list(seen.values()), float)
    n, share = k.sum(axis=1) / k.sum(), k[:, 0] / k.sum(axis=1)
    w, b, rate = np.zeros(len(names)), 0.0, 4.0
    for _ in range(1500):
        off = n * (1 / (1 + np.exp(-((x * w).sum(axis=1) + b))) - share)
        w -= rate * ((x * off[:, None]).sum(axis=0) + 2e-5 * w)
        b -= rate * off.sum()
    total = np.sum(list(tags.values()), axis=0)
    tag = {t: float(np.clip(np.log((c[0] + 1) / total[0] * total[1] / (c[1] + 1)) - 0.1, -0.6, -0.05)) for t, c in tags.items()}
    return Model({v: round(float(w[i]) * SCALE) for v, i in names.items()}, round(b * SCALE), tag)


@cache
def weights() -> Model:
    return fitted(labelled_pages())


#: The most that one piece of foreign text counts against its run, so that a notice does not split an article.
FOREIGN = -1.5
#: Pieces of the run go if their place speaks against them by more than this.
CLEARLY = -1.0


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum, as a half-open range, in one scan; empty if no sum is above 0."""
    best, found, total, since = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, since = 0.0, i + 1
        elif total > best:
            best, found = total, (since, i + 1)
    return found


def tokens(page: str, model: Model) -> Iterator[tuple[float, int, str, float]]:
    """Score, block, text (empty for tags) and what the place says about a word, for the tags and texts of a page."""
    open_ = Open(model.names, bool(_HAS_MAIN.search(page)))
    by_size = {x: model.names.get(x, 0) / SCALE if x else 0.0 for x in ("~short", "~long", None)}
    block = 0
    for kind, value in pieces(page, open_):
        if kind == "text":
            place, text = model.word_score(open_), html.unescape(value)
            n = len(text.split())
            # A piece's size counts for its run only: a run keeps what its place speaks for, however short.
            yield max((place + by_size[size_of(n)] if open_.stack else place) * n, FOREIGN), block, text, place
        elif value == "br":
            yield 0.0, block, " ", 0.0
        elif value in RAW:  # what it holds is left out, but the text around it goes on
            yield model.tags.get(value, -0.3), block, "", 0.0
        elif value not in INLINE and open_.last(*FOREIGN_MARKUP) < 0:
            block += 1
            yield model.tags.get(value, -0.3), block, "", 0.0


def extract(page: str, model: Model | None = None) -> str:
    """The main text: blocks joined by two line feeds."""
    found = list(tokens(page, model or weights()))
    first, after = best_run([t[0] for t in found])
    if first == after:  # nothing speaks for any place: all that nothing speaks against
        first, after = 0, len(found)
    blocks: dict[int, list[str]] = {}
    for _, block, text, place in found[first:after]:
        if place >= CLEARLY:
            blocks.setdefault(block, []).append(text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in texts if x)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = weights()

    def work(batches):
        for whole in batches:
            for batch in slices(whole, 4_000_000, "html"):
                found = [extract(x.decode("utf-8", "replace"), model) for x in texts_of(batch.column("html"))]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
