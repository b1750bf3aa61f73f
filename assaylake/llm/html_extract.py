"""Main-text extraction from web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block-level tags, each with the path of tags
above it. A bidirectional LSTM in numpy reads, for every block, hashed vectors of its tag path and of its words and a few
measures, and labels it as article or not in view of the whole sequence. It is trained on pages that a
generator writes by rule, from a fixed seed, in many layouts; the blocks of the article are known there.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from assaylake.llm._common import slices, with_columns

PATH_SIZE, WORD_SIZE, MEASURES = 160, 24, 8
HIDDEN = 24
TRAINING_PAGES, EPOCHS, BATCH, RATE, SEED = 1600, 14, 24, 0.006, 7
CACHE_ENTRIES = 200_000

# Element kinds of HTML, fixed values.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "select", "canvas", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object param"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom menclose merror semantics annotation".split()
)
#: An opening tag of a key ends an open element of its values, up to an element of the barrier.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that end an open drawing, as in the standard's list for foreign content.
BREAKOUT = "p|div|h[1-6]|ul|ol|dl|li|table|blockquote|pre|body|head|center|nobr|br|hr|img|span|strong|em|b|i|article|section|footer|header|main|aside|nav"
# a drawing is one tag if it closes itself; else it lasts to its end, or, without one before the next drawing, to an element that breaks out
_DRAWING = r"<svg(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*(?:(?<=/)>|>(?:(?:(?!<svg[\s/>]).)*?</svg\s*>|(?:(?!<(?:" + BREAKOUT + r")[\s/>]|</(?:" + BREAKOUT + r")[\s>]|<svg[\s/>]).)*))"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|" + _DRAWING + r"|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)", re.S | re.I
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_NAME = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Leaf:
    """A block: the elements above it, outermost first, its text, and the characters of it that lie in links."""

    path: tuple[str, ...]
    text: str
    linked: int


def _element(tag: str, attributes: str) -> str:
    """An element as its tag and the words of its class, id and role."""
    if not attributes.strip():
        return tag
    words = [w for m in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall(_CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower()) if not w.isdigit()]
    if _HIDDEN.search(attributes):
        words.append("hidden")
    return " ".join([tag, *dict.fromkeys(words)])


def leaves(page: str | None) -> list[Leaf]:
    """The blocks of a page in order, with decoded references and single spaces; empty ones are left out."""
    source = page or ""
    out: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, links = 0, 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Leaf(tuple(e for _, e in stack), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = source[at:end]
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    def close(names: set[str], barrier: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in barrier:
                return

    for m in _TOKEN.finditer(source):
        text_to(m.start())
        at = m.end()
        if m[1]:
            if m[1].lower() not in INLINE:
                flush()
            continue
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[2] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if m[2]:
            if tag == "p" or any(t == tag for t, _ in stack):
                close({tag}, set())
            continue
        if tag in ENDS:
            close(*ENDS[tag])
        close({"p"}, {"table", "td", "th", "li", "div", "section", "article", "blockquote", "aside", "body"})
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            stack.append((tag, _element(tag, m[4])))
    text_to(len(source))
    flush()
    return out


def _signed(features: list[tuple[str, float]], size: int) -> np.ndarray:
    """Weighted features, each in two hashed places with hashed signs."""
    out = np.zeros(size, dtype=np.float32)
    for name, weight in features:
        h = xxhash.xxh64_intdigest(name)
        out[h % size] += weight if h >> 32 & 1 else -weight
        out[(h >> 33) % size] += weight if h >> 63 else -weight
    return out


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """The elements of a path: the tags and names of all, and the tag of the innermost by itself."""
    features: dict[str, float] = {}
    for element in path:
        tag, *names = element.split(" ")
        features[f"tag {tag}"] = 1.0
        for n in names:
            features[f"name {n}"] = 1.0
            features[f"stem {n[:5]}"] = 0.5
    if path:
        features[f"leaf {path[-1].split(' ')[0]}"] = 1.0
    return _signed(sorted(features.items()), PATH_SIZE)


@functools.lru_cache(CACHE_ENTRIES)
def _word_place(word: str) -> tuple[int, float]:
    h = xxhash.xxh64_intdigest(word)
    return h % WORD_SIZE, 1.0 if h >> 63 else -1.0


def word_vector(text: str) -> np.ndarray:
    """The words of a block, hashed with signs, as a vector of fixed length."""
    out = [0.0] * WORD_SIZE
    words = text.lower().split()
    for w in words:
        place, sign = _word_place(w)
        out[place] += sign
    vector = np.array(out, dtype=np.float32)
    return vector * np.float32(0.5 / max(1.0, float(np.sqrt(vector @ vector))))


def measures(leaf: Leaf, place: float) -> list[float]:
    n = len(leaf.text)
    return [1.0, np.log1p(n) / 4, leaf.linked / n, float(leaf.text[-1:] in ".!?:;"), min(1.0, leaf.text.count(" ") / 30), float("©" in leaf.text), place, len(leaf.path) / 10]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Two LSTMs over the blocks of a page, one from each end, and a logistic output on both states."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + MEASURES
        make = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {"out": make(2 * HIDDEN + size, 1) * 0.1}
        for side in ("f", "b"):
            self.weights |= {f"{side}x": make(size, 4 * HIDDEN), f"{side}h": make(HIDDEN, 4 * HIDDEN), f"{side}c": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def inputs(self, page: list[Leaf]) -> np.ndarray:
        rows = np.empty((len(page), PATH_SIZE + WORD_SIZE + MEASURES), dtype=np.float32)
        for i, leaf in enumerate(page):
            vector = self.paths.get(leaf.path)
            if vector is None:
                if len(self.paths) >= CACHE_ENTRIES // 20:
                    self.paths.clear()
                vector = self.paths[leaf.path] = path_vector(leaf.path)
            rows[i, :PATH_SIZE] = vector
            rows[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = word_vector(leaf.text)
            rows[i, PATH_SIZE + WORD_SIZE :] = measures(leaf, i / len(page))
        return rows

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (time, page, HIDDEN) of one LSTM over inputs (time, page, size); masked steps keep the state."""
        w = self.weights
        gates_x = x @ w[f"{side}x"] + w[f"{side}c"]
        steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        out = np.zeros((*x.shape[:2], HIDDEN), dtype=np.float32)
        for t in steps:
            g = gates_x[t] + h @ w[f"{side}h"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            c_new = f * c + i * u
            th = np.tanh(c_new)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, th, m))
            c = np.where(m, c_new, c)
            h = np.where(m, o * th, h)
            out[t] = h
        return out

    @staticmethod
    def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, pages))
        x = np.zeros((longest, len(pages), pages[0].shape[1]), dtype=np.float32)
        mask = np.zeros((longest, len(pages)), dtype=bool)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, True
        return x, mask

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page the probabilities that its blocks belong to the article."""
        x, mask = self._pad(pages)
        states = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b"), x], axis=2)
        p = _sigmoid((states @ self.weights["out"])[:, :, 0])
        return [p[: len(page), k] for k, page in enumerate(pages)]

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss of the blocks, by back-propagation through time."""
        x, mask = self._pad(pages)
        y = np.zeros(mask.shape, dtype=np.float32)
        for k, page in enumerate(labels):
            y[: len(page), k] = page
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(x, mask, s, kept[s]) for s in ("f", "b")] + [x], axis=2)
        error = np.where(mask, _sigmoid((states @ self.weights["out"])[:, :, 0]) - y, 0)[:, :, None] / mask.sum()
        grads = {"out": np.einsum("tbi,tbj->ij", states, error)}
        into = error @ self.weights["out"].T
        for n, s in enumerate(("f", "b")):
            w = self.weights
            gx, gh, gc = np.zeros_like(w[f"{s}x"]), np.zeros_like(w[f"{s}h"]), np.zeros_like(w[f"{s}c"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            for t, h0, c0, i, f, o, u, th, m in reversed(kept[s]):
                dh = dh + into[t, :, n * HIDDEN : (n + 1) * HIDDEN]
                step = dc + dh * o * (1 - th * th)
                gates = np.where(m, np.concatenate([step * u * i * (1 - i), step * c0 * f * (1 - f), dh * th * o * (1 - o), step * i * (1 - u * u)], axis=1), 0)
                gx += x[t].T @ gates
                gh += h0.T @ gates
                gc += gates.sum(axis=0)
                dh, dc = np.where(m, gates @ w[f"{s}h"].T, dh), np.where(m, step * f, dc)
            grads |= {f"{s}x": gx, f"{s}h": gh, f"{s}c": gc}
        return grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS) -> None:
        """Adam over batches of pages of similar length, in an order drawn from the seed."""
        draw = np.random.default_rng(SEED)
        order = np.argsort([len(p) for p in pages], kind="stable")
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            for b in draw.permutation(len(batches)):
                step += 1
                rate = RATE * (1 - epoch / epochs) ** 0.5
                for k, g in self.gradients([pages[i] for i in batches[b]], [labels[i] for i in batches[b]]).items():
                    g = np.clip(g, -1, 1) + 1e-5 * self.weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.weights[k] = self.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)


#: Names of elements that hold an article, and of elements that do not, by kind.
ARTICLE_NAMES = ("content", "main-content", "post", "post-body", "entry-content", "article-body", "story", "text", "page-content", "body-copy", "main", "blog-post", "prose", "single-post", "news-text", "mw-content-text")
BOILERPLATE = {
    "menu": ("nav", "navbar", "menu", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "topnav", "pagination", "tabs"),
    "header": ("header", "site-header", "masthead", "topbar", "branding", "logo", "page-header"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon", "page-footer"),
    "sidebar": ("sidebar", "aside", "widget", "related", "related-posts", "recommended", "trending", "most-read", "side-column", "rail"),
    "notice": ("cookie", "cookie-notice", "notice", "banner", "consent", "alert", "popup", "modal", "paywall", "gdpr"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "adsense", "ad-slot", "promotion"),
    "form": ("login", "search", "newsletter", "subscribe", "signup", "contact-form", "register"),
    "share": ("share", "social", "sharing", "social-links", "follow", "tags", "byline-links"),
    "comments": ("comments", "comment", "comment-list", "reader-comments", "disqus", "responses", "respond", "replies", "discussion"),
}
_TAGS = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "aside", "dialog"), "advert": ("div", "aside", "section"), "form": ("form", "div"), "share": ("div", "ul"), "comments": ("section", "div", "ol")}
_CUES = ("home", "about", "contact", "login", "read more", "share", "subscribe", "privacy policy", "terms of use", "cookies", "accept", "© 2020", "all rights reserved", "sponsored", "advertisement", "reply", "posted by", "newsletter", "search")
_KEEP = "\x07"


class PageWriter:
    """Writes pages by rule. Texts of the article start with a mark that no page has by itself."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.draw
        made = ["".join(r.choice(("an", "er", "ou", "ti", "ré", "ung", "ción", "st", "le", "ha", "mo", "ka")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        text = " ".join(made)
        kind = r.random()
        if kind < 0.6:
            return text.capitalize() + r.choice(".. .!?")
        if kind < 0.75:
            return " ".join(w + r.choice(("%%%", "***", "$$$", "###", "&amp;&amp;", "|", "")) for w in made)
        return r.choice((text, text + ", " + r.choice(_CUES), f"&copy; {text}", f"{r.choice(_CUES)} {text}")) if kind < 0.9 else text

    def open(self, tag: str, names: tuple[str, ...] | None) -> str:
        r = self.draw
        if not names:
            return f"<{tag}>"
        key = r.choice(("class", "class", "id"))
        extra = f" {r.choice(('col', 'row', 'wrap', 'box', 'block', 'inner', 'clearfix', 'x1'))}" if r.random() < 0.25 else ""
        return f'<{tag} {key}="{r.choice(names)}{extra}">'

    def boilerplate(self, kind: str, deep: int = 0) -> str:
        r = self.draw
        tag = r.choice(_TAGS[kind])
        semantic = tag in ("nav", "header", "footer", "aside", "form")
        names = None if semantic and r.random() < 0.5 else BOILERPLATE[kind]
        inner: list[str] = []
        if kind == "comments":
            inner += [f"<{r.choice(('h2', 'h3'))}>{self.words(1, 4)}</h2>"] * (r.random() < 0.5)
            for _ in range(r.randint(1, 6)):
                said = f"<p>{self.words(3, 70)}</p>"
                inner.append(r.choice((f'<div class="comment">{said}</div>', f"<li>{said}</li>", f'<article class="comment"><p>{self.words(1, 3)}</p>{said}</article>', said)))
        elif kind in ("menu", "share") or r.random() < 0.3:
            items = "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(r.randint(1, 8)))
            inner.append(items if tag == "ul" else r.choice((f"<ul>{items}</ul>", " ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(r.randint(1, 6))))))
        else:
            for _ in range(r.randint(1, 3)):
                inner.append(r.choice((f"<p>{self.words(2, 30)}</p>", self.words(2, 25), f"<div>{self.words(2, 20)}</div>", f"<h3>{self.words(1, 5)}</h3>", f'<a href="/y">{self.words(1, 4)}</a>')))
        if kind == "form":
            inner.append(r.choice((f"<label>{self.words(1, 3)}</label><input name=q>", f"<button>{self.words(1, 2)}</button>")))
        if deep < 1 and r.random() < 0.15:
            inner.append(self.boilerplate(r.choice(("menu", "share", "form")), deep + 1))
        return f"{self.open(tag, names)}{''.join(inner)}</{tag}>"

    def article_block(self) -> str:
        r = self.draw
        k = _KEEP
        kind = r.random()
        if kind < 0.62:
            body = self.words(1, 90)
            return r.choice((f"<p>{k}{body}</p>", f"<p>{k}{body}</p>", f"<p>{k}{body}", f"<p><b>{k}{body}<br>", f'<p>{k}{body} <a href="/z">{self.words(1, 4)}</a> {self.words(1, 9)}</p>', f"<div>{k}{body}</div>"))
        if kind < 0.75:
            tag = r.choice(("h2", "h3", "h4"))
            return f"<{tag}>{k}{self.words(1, 8)}</{tag}>"
        if kind < 0.87:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>{''.join(f'<li>{k}{self.words(1, 15)}</li>' for _ in range(r.randint(1, 5)))}</{tag}>"
        if kind < 0.93:
            return r.choice((f"<blockquote><p>{k}{self.words(4, 40)}</p></blockquote>", f"<pre>{k}{self.words(2, 20)}</pre>", f"<section><p>{k}{self.words(3, 40)}</p></section>", f"<dl><dt>{k}{self.words(1, 3)}<dd>{k}{self.words(2, 20)}</dl>"))
        return f"<table>{''.join(f'<tr><td>{k}{self.words(1, 3)}</td><td>{k}{self.words(1, 6)}</td></tr>' for _ in range(r.randint(1, 3)))}</table>" if kind < 0.97 else f"<figure><img src=x><figcaption>{k}{self.words(2, 12)}</figcaption></figure>"

    def page(self) -> str:
        r = self.draw
        plain = r.random() < 0.3  # a short page with the semantic elements
        title = self.words(2, 12)
        inner = [r.choice((f"<h1>{_KEEP}{title}</h1>", f"<h1>{_KEEP}{title}</h1>", f"<header><h1>{_KEEP}{title}</h1></header>", ""))]
        for _ in range(r.choice((1, 2, 3, 5, 8, 12, 25))):
            inner.append(self.article_block())
            if not plain and r.random() < 0.08:
                inner.append(self.boilerplate(r.choice(("advert", "share", "sidebar", "form", "notice"))))
        if all(_KEEP not in x for x in inner):
            inner.append(f"<p>{_KEEP}{self.words(5, 40)}</p>")
        after = [] if plain else [self.boilerplate(k) for k in ("share", "comments", "sidebar", "form") if r.random() < 0.3]
        style = r.random()
        if plain or style < 0.4:
            article = f"{self.open('article', None if plain or r.random() < 0.6 else ARTICLE_NAMES)}{''.join(inner)}{''.join(after) if r.random() < 0.4 else ''}</article>"
        elif style < 0.6:
            article = f"<main>{''.join(inner)}</main>"
        else:
            article = f"{self.open('div', ARTICLE_NAMES)}{''.join(inner)}</div>"
        if style > 0.8:
            article = f'<div class="{r.choice(("container", "wrapper", "page", "layout"))}">{article}</div>'
        before = [self.boilerplate(k) for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.85), ("advert", 0.6), ("form", 0.2), ("sidebar", 0.25)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        rest = [self.boilerplate(k) for k, p in (("sidebar", 0.25), ("advert", 0.25), ("comments", 0.25), ("footer", 0.9), ("notice", 0.15)) if r.random() < p]
        head = f'<head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var a="</p>";</script></head>'
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}<!-- x -->{article}{'' if f'{article}'.count('</article>') and after and style < 0.4 else ''.join(after)}{''.join(rest)}</body></html>"


def labelled_page(writer: PageWriter) -> tuple[list[Leaf], np.ndarray]:
    """The blocks of a written page without the mark, and which of them belong to the article."""
    found = leaves(writer.page())
    kept = np.array([_KEEP in x.text for x in found], dtype=np.float32)
    return [Leaf(x.path, " ".join(x.text.replace(_KEEP, " ").split()) or "-", x.linked) for x in found], kept


@functools.lru_cache(1)
def default_model() -> BlockLabeller:
    """The labeller fitted to generated pages; the same in every process."""
    writer = PageWriter(SEED)
    pages = [labelled_page(writer) for _ in range(TRAINING_PAGES)]
    model = BlockLabeller()
    model.fit([model.inputs(p) for p, _ in pages], [y for _, y in pages])
    return model


def main_texts(pages: list[str | None], model: BlockLabeller) -> list[str]:
    """The article of each page: its blocks in page order, joined by one newline; empty if there is none."""
    blocks = [leaves(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    while order:
        # pages of similar length together, the fewer the longer they are
        take = max(1, min(len(order), 128, 20_000 // len(blocks[order[-1]]) or 1))
        group, order = order[-take:], order[:-take]
        for i, p in zip(group, model.scores([model.inputs(blocks[i]) for i in group]), strict=True):
            out[i] = "\n".join(b.text for b, x in zip(blocks[i], p, strict=True) if x >= 0.5)
    return out


def extract(pages: DataFrame, html_col: str = "html", model: BlockLabeller | None = None, text_col: str = "main_text") -> DataFrame:
    """The columns of ``pages`` and ``main_text``; a column of that name is replaced.

    A null or empty page, and one without an article, gives an empty text. Unclosed, misnested and cut-off markup
    is read as a browser would close it. A page is labelled by itself, so repeated rows agree. An empty table
    gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    rows = pages.drop(text_col)
    place = rows.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = pa.array(main_texts(batch.column(place).to_pylist(), shared.value), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], schema=pa.schema([*batch.schema, (text_col, pa.string())]))

    return rows.mapInArrow(run, with_columns(rows, {text_col: StringType()}))
