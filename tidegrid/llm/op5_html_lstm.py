"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks (text between block-level tags) in page order. Each block is a vector: its tag path (the
distinct tags on the way down, and the words in their classes, ids and roles that name a part of a page, hashed; its own tag
apart), its words (hashed), its length, link share and place. A name counts once, so a path is as telling 300 elements deep as 3.
A bidirectional LSTM reads the whole sequence of a page's blocks forwards and backwards and labels each block as main text or not,
so that what stands before and after a block counts. Numpy only.

There are no labels for pages. The network is trained on a bounded sample of the pages with labels from a structural rule
(``teacher``; where a page names no article, ``plain_teacher`` looks at length, links and ends of sentences), and on pages made of
the same texts (``variants``), whose labels are known: articles with lists, tables, subheadings, definitions and quotes under
various names or none, and menus, notices, forms, sidebars, related links and comments around and inside them. The model has a
fixed size and is broadcast; pages are labelled in the tasks that read them, without a shuffle, whole.

Defined results: null or empty html gives an empty text; text outside any tag is a block of its own; unclosed tags are closed
as browsers do for paragraphs, list items, definitions and cells; repeated pages are labelled alike; a null id or url stays null; a table without any running text gives empty texts; an empty table
gives an empty table; further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages trained on, variants of each, blocks of all these pages (whole pages only), characters up to which a page is trained on;
#: hidden units per direction; passes.
SAMPLE, VARIANTS, TRAIN_BLOCKS, TRAIN_CHARS, HIDDEN, PASSES = 240, 8, 15_360, 1 << 20, 24, 10
#: Characters of the pages that are labelled together; blocks whose vectors are made at a time.
TOGETHER, SLICE = 4 << 20, 20_000
PATH_SIZE, WORD_SIZE = 384, 48
WIDTH = PATH_SIZE + WORD_SIZE + 6

#: Tags that don't end a block, tags without content, and tags that end an open one of the same kind.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag ends if they are open, up to the nearest element that holds them apart.
ENDS = {"p": "p", "li": "li p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p", "option": "option p"}
APART = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "table tr", "th": "table tr", "option": "select"}
APART_ELSE = "div section article table ul ol td th blockquote main aside nav header footer form"
#: Tags that a block's path tells apart; others count as one.
PATH_TAGS = frozenset(
    "html body head title nav header footer aside main article section div p ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre form fieldset "
    "legend figure figcaption details summary address select option textarea button center dialog menu dir".split()
)
#: Words in tags, classes and ids that mark an article, and what isn't one; the last only as tags.
MAIN_NAMES = frozenset("article main content post story entry maintext".split())
OTHER_NAMES = frozenset(
    "nav header footer aside form ad ads advert advertisement banner promo sponsor sponsored cookie consent notice sidebar menu navigation breadcrumb breadcrumbs "
    "comment comments replies share social related newsletter subscribe dialog popup modal".split()
)
OTHER_TAGS = frozenset("button select textarea input head title".split())

#: Tags whose content is no text of the page; those of the second kind hold it only if they are closed.
SILENT = frozenset("script style".split())
EMBEDDED = frozenset("template noscript svg iframe object".split())
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
#: A whole tag without an angle in its attributes, as almost all are.
_WHOLE = re.compile(r"(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[-_.\d\s]+")


@dataclass
class Block:
    """``path``: the distinct tags and naming words on the way down, in order of appearance; ``links``: characters inside links; ``own``: the innermost tag."""

    path: tuple[str, ...]
    text: str
    links: int
    own: str = ""


def _naming_words(raw: str) -> list[str]:
    """Words of classes, ids and roles that name a part of a page."""
    if "=" not in raw:
        return []
    return [w for m in _NAMES.finditer(raw) for w in _SPLIT.split((m[2] or m[3] or m[4] or "").lower()) if w in MAIN_NAMES or w in OTHER_NAMES]


class _Open:
    """The open elements, with the place of each tag among them: every element is opened and closed once, however deep."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}

    def last(self, tags: str) -> int:
        return max((places[-1] for t in tags.split() if (places := self.at.get(t))), default=-1)

    def cut(self, place: int) -> None:
        """Close all elements from ``place`` on."""
        while len(self.stack) > place:
            self.at[self.stack.pop()[0]].pop()

    def close(self, tag: str) -> None:
        if places := self.at.get(tag):
            self.cut(places[-1])

    def open(self, tag: str, inside: str) -> None:
        ended = self.last(ENDS.get(tag, "p"))
        if ended > self.last(APART.get(tag, APART_ELSE)):
            self.cut(ended)
        above = self.stack[-1][1] if self.stack else ()
        new = dict.fromkeys([tag if tag in PATH_TAGS else "other", *_naming_words(inside)])
        more = tuple(x for x in new if x not in above)
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, above + more if more else above))

    def block(self, text: str, links: int) -> Block:
        tag, path = self.stack[-1] if self.stack else ("", ())
        return Block(path, text, links, tag if tag in PATH_TAGS else "")


class _Reader:
    """Splits a page into text and tags, in time linear in its length: what isn't found once isn't looked for again."""

    def __init__(self, html: str):
        self.html = html
        self.gone: dict[str, bool] = {}
        self.quotes = True

    def find(self, what: str, at: int) -> int:
        """The next place of ``what``, which must not move backwards between calls once it's gone; -1 if there is none."""
        if what in self.gone:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.gone[what] = True
        return found

    def tag_end(self, at: int) -> int:
        """The place of the tag's closing sign, quoted ones left out unless a quote stays open; -1 if there is none."""
        if self.find(">", at) < 0:
            return -1
        here = at
        while self.quotes and (m := _STOP.search(self.html, here)):
            if m[0] == ">":
                return m.start()
            here = self.find(m[0], m.end()) + 1
            if not here:
                self.quotes = False
        self.quotes = False  # from here on, the first sign ends a tag
        return self.find(">", at)

    def tags(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(begin, end, closing, name, attributes) of each tag; comments and silent elements have no name."""
        html, at = self.html, 0
        closers = _Closers(html)
        while (begin := self.find("<", at)) >= 0:
            at = begin + 1
            if html.startswith("<!--", begin):
                end = self.find("-->", begin + 4)
                at = end + 3 if end >= 0 else len(html)
                yield begin, at, False, "", ""
            elif (whole := _WHOLE.match(html, at)) or (m := _TAG.match(html, at)):
                if whole:
                    closing, name, inside, at = bool(whole[1]), whole[2].lower(), whole[3], whole.end()
                else:
                    end = self.tag_end(m.end())
                    if end < 0:
                        continue
                    closing, name, inside, at = bool(m[1]), m[2].lower(), html[m.end() : end], end + 1
                if not closing and name in SILENT:
                    at = closers.after(name, at, len(html))
                    yield begin, at, False, "", ""
                elif not closing and name in EMBEDDED and not (name == "svg" and inside.endswith("/")) and (after := closers.after(name, at, -1)) >= 0 and not closers.opens(name, at, after):
                    at = after
                    yield begin, at, False, "", ""
                else:
                    yield begin, at, closing, name, inside
            elif html[at : at + 1] in ("!", "?", "/"):
                end = self.find(">", at)
                if end >= 0:
                    at = end + 1
                    yield begin, at, False, "!", ""


class _Closers:
    """Where the elements of ``SILENT`` and ``EMBEDDED`` open and close, found in one pass."""

    def __init__(self, html: str):
        self.open: dict[str, list[int]] = {}
        self.close: dict[str, list[tuple[int, int]]] = {}
        sign = 0
        for m in re.finditer(rf"<(/?)({'|'.join(sorted(SILENT | EMBEDDED))})(?=[\s/>])", html, re.I):
            if m[1]:
                if -1 < sign < m.end():  # the sign found last is found again, so that no part of the page is looked through twice
                    sign = html.find(">", m.end())
                if sign >= 0:
                    self.close.setdefault(m[2].lower(), []).append((m.start(), sign + 1))
            else:
                self.open.setdefault(m[2].lower(), []).append(m.start())

    def after(self, name: str, at: int, otherwise: int) -> int:
        """The end of the first closing tag from ``at`` on."""
        found = self.close.get(name, [])
        i = bisect_left(found, (at, 0))
        return found[i][1] if i < len(found) else otherwise

    def opens(self, name: str, at: int, upto: int) -> bool:
        """Whether another such element opens before ``upto``."""
        found = self.open.get(name, [])
        i = bisect_left(found, at)
        return i < len(found) and found[i] < upto


def read_blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page, in order; comments, scripts and styles hold none."""
    blocks: list[Block] = []
    if not html:
        return blocks
    elements = _Open()
    parts: list[str] = []
    links, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(elements.block(text, links))
            parts.clear()
        links = 0

    for begin, end, closing, tag, inside in _Reader(html).tags():
        if begin > at:
            piece = html[at:begin]
            parts.append(piece)
            if in_link:
                links += len(piece)
        at = end
        if not tag:
            if html[begin + 1] != "!":
                parts.append(" ")
            continue
        if tag == "!":
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        flush()
        if closing:
            elements.close(tag)
        elif tag not in VOID:
            elements.open(tag, inside)
    if at < len(html):
        parts.append(html[at:])
    flush()
    return blocks


def _kind(name: str) -> int:
    """1: an article's name, -1: another part's, 0: neither."""
    return -1 if name in OTHER_NAMES or name in OTHER_TAGS else int(name in MAIN_NAMES)


def teacher(block: Block) -> int:
    """Main text: under an article's name, and under no other part's name inside it or outside it."""
    kinds = [_kind(x) for x in block.path]
    return int(1 in kinds and -1 not in kinds)


def plain_teacher(block: Block) -> int:
    """For pages without any article's name: running text that isn't mostly links and stands under no other part's name."""
    words = len(block.text.split())
    running = words >= 12 or words >= 5 and block.text[-1] in ".!?:\"”"
    return int(running and 3 * block.links < len(block.text) and not any(_kind(x) == -1 for x in block.path))


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = _hash(word)
        return h


_hashes = _Hashes()
_paths: dict[tuple[tuple[str, ...], str], np.ndarray] = {}


def _path_vector(path: tuple[str, ...], own: str) -> np.ndarray:
    """Each name once, at three places, so that no two names share them all; the own tag once more under another name; long paths are scaled down."""
    if (path, own) not in _paths:
        if len(_paths) > 20_000:
            _paths.clear()
        v = np.zeros(PATH_SIZE, dtype=np.float32)
        for name in (*(f"path {x}" for x in path), f"own {own}"):
            digest = hashlib.blake2b(name.encode(), digest_size=12).digest()
            for k in range(0, 12, 4):
                h = int.from_bytes(digest[k : k + 4], "little")
                v[h % PATH_SIZE] += 1.0 if h >> 31 else -1.0
        _paths[path, own] = v / max(1.0, np.sqrt(len(path) / 8))
    return _paths[path, own]


def block_vectors(blocks: list[Block], first: int = 0, of: int | None = None) -> np.ndarray:
    """One row per block; ``blocks`` may be a part of a page of ``of`` blocks, from its block ``first`` on."""
    out = np.zeros((len(blocks), WIDTH), dtype=np.float32)
    of = len(blocks) if of is None else of
    for i, b in enumerate(blocks):
        out[i, :PATH_SIZE] = _path_vector(b.path, b.own)
        words = b.text.lower().split()
        h = np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))
        out[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.bincount(h % WORD_SIZE, np.where(h >> 16 & 1, 1.0, -1.0), WORD_SIZE)[:WORD_SIZE] / np.sqrt(len(words) + 1)
        n = len(b.text)
        out[i, -6:] = np.log1p(n) / 8, min(1.0, b.links / n), b.text[-1] in ".!?:\"”", len(words) < 4, (first + i) / of, 1.0
    return out


#: Paths below html and body: of articles, of what isn't one, and of wrappers that say nothing.
ARTICLES = ("main", "article", "div content", "div post", "section story", "div entry content", "main article", "div main content", "div maintext", "article div entry")
OTHERS = (
    "nav ul", "div menu ul", "div navigation ul", "header", "header nav ul", "footer", "footer ul", "aside", "aside ul", "div sidebar", "div sidebar ul", "div cookie notice", "div consent",
    "form", "form fieldset", "section comments div comment", "ol comments", "div comments", "div replies", "div related ul", "div related", "div ad", "div ads", "div advert", "div advertisement",
    "div banner", "div promo", "div sponsor", "div sponsored", "div share ul", "div social", "div newsletter", "div subscribe form", "div breadcrumb", "ol breadcrumbs", "div popup", "div modal", "dialog", "aside table tbody tr",
    "form button", "form select option", "div button",
)
WRAPPERS = ("div", "div section", "table tbody tr td", "center", "div other", "section", "")


def variants(blocks: list[Block], labels: list[int], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page made of the texts of another: an article under one of many names or none, with all kinds of blocks in it, amid other parts."""
    own = [b.text for b, y in zip(blocks, labels) if y][:14]
    spare = [b.text for b, y in zip(blocks, labels) if not y] or ["menu"]
    pick = lambda some: some[rng.integers(len(some))]

    def phrase(least: int, most: int) -> str:
        words = pick(own).split()
        n = int(rng.integers(least, most + 1))
        at = int(rng.integers(0, max(1, len(words) - n)))
        return " ".join(words[at : at + n]) or "word"

    plain = rng.random() < 0.3
    root = ("html", "body", *pick(WRAPPERS).split(), *pick(WRAPPERS).split())
    inside = root if plain else (*root, *pick(ARTICLES).split(), *pick(WRAPPERS).split())
    out, marks = [], []

    def put(path: tuple[str, ...], tag: str, text: str, link: bool, y: int) -> None:
        out.append(Block(tuple(dict.fromkeys((*path, *tag.split()))), text, len(text) if link else 0, tag.split()[-1]))
        marks.append(y)

    def other(where: tuple[str, ...]) -> None:
        """Links, sentences or labels of another part."""
        path = (*where, *pick(OTHERS).split())
        kind, of = rng.integers(3), "li" if path[-1] in ("ul", "ol") else "td" if path[-1] == "tr" else ""
        if rng.random() < 0.3:
            put(path[:-1] if of else path, pick(("h2", "h3", "h4", "p", "div")), phrase(1, 3), False, 0)
        for _ in range(1 if rng.random() < 0.5 else int(rng.integers(2, 6))):
            put(path, of or pick(("p", "div", "h3", "ul li", "p", "h2")), phrase(1, 4) if kind == 0 else pick(own) if kind == 1 else pick(spare), kind == 0 or rng.random() < 0.2, 0)

    def links() -> None:
        """A menu that no name marks."""
        for _ in range(int(rng.integers(2, 8))):
            put(root, "ul li", phrase(1, 3), True, 0)

    def some_blocks() -> None:
        """A list, table, definitions, subheading or quote of the article."""
        kind = rng.integers(7)
        linked = not plain and rng.random() < 0.3
        if kind <= 1:
            for _ in range(int(rng.integers(2, 7))):
                put(inside, ("ul li", "ol li")[kind], phrase(1 if not plain else 4, 14), linked, 1)
        elif kind == 2:
            for _ in range(int(rng.integers(2, 5))):
                for tag in ("th", "td", "td") if rng.random() < 0.5 else ("td", "td"):
                    put(inside, f"table {'tbody ' if rng.random() < 0.5 else ''}tr {tag}", phrase(1, 5), linked and tag == "td", 1)
        elif kind == 3:
            for _ in range(int(rng.integers(1, 4))):
                put(inside, "dl dt", phrase(1, 3), False, 1)
                put(inside, "dl dd", phrase(2, 14), linked, 1)
        elif kind <= 5:
            put(inside, pick(("h2", "h3", "h4", "h2")), phrase(1, 8), linked and rng.random() < 0.3, 1)
        else:
            put(inside, pick(("blockquote p", "pre", "blockquote", "div", "figure p", "figure figcaption", "details summary")), phrase(4, 30), False, 1)

    if rng.random() < 0.7:
        put(("html", "head"), "title", pick(spare), False, 0)
    for _ in range(int(rng.integers(0, 3))):
        links() if plain or rng.random() < 0.3 else other(root)
    if rng.random() < 0.8:
        put(inside, "h1", phrase(2, 10), False, 1)
    for k, text in enumerate(own):
        if k and rng.random() < 0.35:
            some_blocks()
        if k and rng.random() < 0.25:
            other(inside)
        put(inside, "p" if rng.random() < 0.85 else pick(("div", "li", "section p", "td")), text, rng.random() < 0.03, 1)
    if rng.random() < 0.3:
        some_blocks()
    for _ in range(int(rng.integers(0, 4))):
        links() if rng.random() < 0.25 else other(inside if rng.random() < 0.3 else root)
    return out, marks


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BiLSTM:
    """Parameters by name: per direction ``w`` (input and state to four gates, with bias), and the output layer."""

    p: dict[str, np.ndarray]
    hidden: int = HIDDEN

    @classmethod
    def start(cls, width: int = WIDTH, hidden: int = HIDDEN, seed: int = 11) -> BiLSTM:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[d] = (rng.standard_normal((width + hidden, 4 * hidden)) * np.sqrt(1 / (width + hidden))).astype(np.float32)
            p[d + "0"] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden))).astype(np.float32)
        p["o"] = (rng.standard_normal(2 * hidden) * 0.1).astype(np.float32)
        p["o0"] = np.zeros(1, dtype=np.float32)
        return cls(p, hidden)

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: pages, blocks, width, in reading order of this direction. Masked blocks leave the state as it is."""
        pages, steps, width = x.shape
        n, w = self.hidden, self.p[d]
        h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        inputs = np.concatenate([x[:, k : k + SLICE] @ w[:width] for k in range(0, max(steps, 1), SLICE)], axis=1) + self.p[d + "0"]
        out, trace = np.zeros((pages, steps, n), np.float32), []
        for t in range(steps):
            z = inputs[:, t] + h @ w[width:]
            i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
            m = mask[:, t : t + 1]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                trace.append((h, c, i, f, o, g, tc, m))
            c, h = m * new + (1 - m) * c, m * (o * tc) + (1 - m) * h
            out[:, t] = h
        return out, trace

    def _back(self, d: str, x: np.ndarray, trace: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, w = self.hidden, self.p[d]
        width = x.shape[2]
        gw, gb = np.zeros_like(w), np.zeros(4 * n, np.float32)
        gh, gc = np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0])
        for t in range(len(trace) - 1, -1, -1):
            h, c, i, f, o, g, tc, m = trace[t]
            gh = gh + grad[:, t]
            dh, dc = gh * m, gc * m
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)), axis=1)
            gw[:width] += x[:, t].T @ dz
            gw[width:] += h.T @ dz
            gb += dz.sum(axis=0)
            gh = gh * (1 - m) + dz @ w[width:].T
            gc = gc * (1 - m) + dc * f
        return gw, gb

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, _ = self._pass("f", x, mask, False)
        hb, _ = self._pass("b", x[:, ::-1], mask[:, ::-1], False)
        n = self.hidden
        return hf @ self.p["o"][:n] + hb[:, ::-1] @ self.p["o"][n:] + self.p["o0"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over unmasked blocks and its gradients."""
        n = self.hidden
        hf, tf = self._pass("f", x, mask, True)
        hb, tb = self._pass("b", x[:, ::-1], mask[:, ::-1], True)
        hb = hb[:, ::-1]
        z = hf @ self.p["o"][:n] + hb @ self.p["o"][n:] + self.p["o0"]
        q = _sigmoid(z)
        total = max(1.0, float(mask.sum()))
        loss = float(-(mask * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).sum() / total)
        dz = ((q - y) * mask / total).astype(np.float32)
        g = {"o": np.concatenate(((hf * dz[..., None]).sum(axis=(0, 1)), (hb * dz[..., None]).sum(axis=(0, 1)))), "o0": np.array([dz.sum()], np.float32)}
        g["f"], g["f0"] = self._back("f", x, tf, dz[..., None] * self.p["o"][:n])
        g["b"], g["b0"] = self._back("b", x[:, ::-1], tb, (dz[..., None] * self.p["o"][n:])[:, ::-1])
        return loss, g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], passes: int = PASSES, batch: int = 32, rate: float = 0.01, seed: int = 5) -> float:
        """Adam over batches of pages of like length; returns the last loss."""
        rng = np.random.default_rng(seed)
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        batches = [padded([pages[i] for i in order[k : k + batch]]) for k in range(0, len(order), batch)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, loss = 0, 0.0
        for _ in range(passes):
            for k in rng.permutation(len(batches)):
                step += 1
                loss, g = self.gradients(*batches[k])
                size = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
                for name, x in g.items():
                    x = x * min(1.0, 5.0 / (size + 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * x
                    v[name] = 0.999 * v[name] + 0.001 * x**2
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss

    def label(self, pages: list[np.ndarray], most: int = 40_000) -> list[np.ndarray]:
        """Main-text marks of each page's blocks; pages of like length run together, ``most`` blocks at a time."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        k = 0
        while k < len(order):
            e = k + 1
            while e < len(order) and e - k < 256 and (e - k + 1) * len(pages[order[e]]) <= most:
                e += 1
            part = order[k:e]
            x, mask, _ = padded([(pages[i], np.zeros(len(pages[i]))) for i in part])
            z = self.logits(x, mask) if x.shape[1] else np.zeros((len(part), 0))
            for i, row in zip(part, z):
                out[i] = row[: len(pages[i])] > 0
            k = e
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, mask and labels of pages padded to the longest."""
    steps = max(len(y) for _, y in pages)
    x = np.zeros((len(pages), steps, WIDTH), np.float32)
    mask, y = np.zeros((len(pages), steps), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, (a, b) in enumerate(pages):
        x[i, : len(a)], mask[i, : len(a)], y[i, : len(b)] = a, 1, b
    return x, mask, y


def fit_labeller(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", html_col: str = "html") -> BiLSTM | None:
    """A network trained on the blocks of at most ``sample`` pages, which the executors read from the html."""
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).where("page_id is not null and html is not null")
    n = plain.select("page_id").count()
    spread = F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) / 1_000_000.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for spread, html in zip(b["spread"], b["html"]):
                blocks = read_blocks(html)
                yield pd.DataFrame({"spread": [spread], "paths": [[[x.own, *x.path] for x in blocks]], "texts": [[x.text for x in blocks]], "links": [[x.links for x in blocks]]})

    plain = plain.where(F.length("html") <= TRAIN_CHARS)
    picked = plain.withColumn("spread", spread).where(F.col("spread") < min(1.0, 1.2 * sample / max(1, n) + 8 / max(1, n))).select("spread", "html")
    found = picked.mapInPandas(run, "spread double, paths array<array<string>>, texts array<string>, links array<long>").toPandas()
    found = found.sort_values("spread", kind="stable").head(sample)
    rng = np.random.default_rng(23)
    train, held = [], 0
    for r in found.itertuples():
        if held and held + len(r.texts) > TRAIN_BLOCKS:
            continue
        held += len(r.texts)
        blocks = [Block(tuple(p[1:]), t, int(k), p[0]) for p, t, k in zip(r.paths, r.texts, r.links)]
        if not blocks:
            continue
        labels = [teacher(b) for b in blocks]
        if not any(labels):
            labels = [plain_teacher(b) for b in blocks]
        if any(labels):
            train.append((block_vectors(blocks), np.array(labels)))
            for _ in range(VARIANTS):
                b, y = variants(blocks, labels, rng)
                train.append((block_vectors(b), np.array(y)))
    if not train:
        return None
    model = BiLSTM.start()
    model.train(train)
    return model


def extract_main_text(pages: DataFrame, model: BiLSTM | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = sent.value
        for b in batches:
            sizes = b["html"].str.len().fillna(0).cumsum().to_numpy() // TOGETHER  # pages of so many characters at a time, or one larger page
            for i, e in zip(np.flatnonzero(np.diff(sizes, prepend=-1)), [*np.flatnonzero(np.diff(sizes)) + 1, len(b)]):
                part = b.iloc[i:e]
                read = [read_blocks(h) for h in part["html"]]
                marks = net.label([block_vectors(x) for x in read]) if net else [np.zeros(len(x), bool) for x in read]
                texts = ["\n".join(x.text for x, keep in zip(blocks, m) if keep) for blocks, m in zip(read, marks)]
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(x) for x in read], "n_main": [int(m.sum()) for m in marks]})

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInPandas(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
