"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

Each block has features of its ancestors' tags, their class and id names, and its text; a label is main or not. The weights
are fitted by gradient ascent on the likelihood over labelled pages of many layouts, made by
:func:`labelled_pages`, a bounded set (``PAGES``); pages are decoded by Viterbi where they are read, one at a time.

Defined cases: null and empty pages have an empty text; unclosed tags, comments and character references at the end of a cut page
are dropped or decoded as browsers do; very long pages are read whole; equal pages have equal texts; a null id or URL is kept;
an empty table gives no row; further columns are left out.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.batches import small
from touchline.llm.html_blocks import Block, blocks

#: labelled pages that the weights are fitted on
PAGES = 600
_KEYWORD = re.compile(r"\b(cookies?|privacy|subscribe|newsletter|sign (?:in|up)|log ?in|share|reply|comments?|copyright|advertisement|sponsored|related|read more)\b|©", re.I)


def features(page: list[Block]) -> list[list[str]]:
    out = []
    total = max(1, len(page))
    for i, b in enumerate(page):
        n = len(b.text)
        linked = 4 * min(b.link_chars, n) // n
        f = ["bias", f"t:{b.tag}", f"len:{min(10, n.bit_length())}", f"link:{linked}", f"end:{b.text[-1] in '.!?:;…'}", f"at:{4 * i // total}"]
        f += [f"a:{t}" for t in b.tags]
        f += [f"c:{c}" for c in b.names]
        if b.tags & {"article", "main"}:
            f.append("inside")
            f.append(f"inside, named {bool(b.names)}, apart {bool(b.tags & {'nav', 'aside', 'footer', 'form', 'button', 'select'})}, once {len(b.tags & {'article', 'main'})}")
        if b.tags & {"nav", "aside", "footer", "form", "button", "select"} or "header" in b.tags and not b.tags & {"article", "main"}:
            f.append("outside")
        f += [f"k:{k.lower()}" for k in {m[0] for m in _KEYWORD.finditer(b.text[:400])}] if n < 400 else []
        out.append(f)
    return out


class Field:
    """Weights of a chain of two labels, 0 and 1."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.index, self.emit, self.step = index, emit, step

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi."""
        index, emit, step = self.index, self.emit, self.step.tolist()
        best, back = None, []
        for f in page:
            e = emit[[index[x] for x in f if x in index]].sum(0).tolist()
            if best is None:
                best = e
                continue
            came, now = [], []
            for y in (0, 1):
                a, b = best[0] + step[0][y], best[1] + step[1][y]
                came.append(int(b > a))
                now.append(max(a, b) + e[y])
            best = now
            back.append(came)
        if best is None:
            return []
        y = int(best[1] > best[0])
        out = [y]
        for came in reversed(back):
            y = came[y]
            out.append(y)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 100, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a small penalty; all pages go through forward and backward sums together."""
    index: dict[str, int] = {}
    for page, _ in pages:
        for f in page:
            for x in f:
                index.setdefault(x, len(index))
    pages = [p for p in pages if p[0]]
    s, t = len(pages), max(len(p) for p, _ in pages)
    row = np.array([i * t + j for i, (p, _) in enumerate(pages) for j, f in enumerate(p) for _ in f])
    col = np.array([index[x] for p, _ in pages for f in p for x in f])
    label = np.zeros((s, t), np.int64)
    there = np.zeros((s, t), bool)
    for i, (_, y) in enumerate(pages):
        label[i, :len(y)], there[i, :len(y)] = y, True
    truth = np.eye(2)[label] * there[..., None]
    pair = np.einsum("ija,ijb->ab", truth[:, :-1], truth[:, 1:])
    emit, step = np.zeros((len(index), 2)), np.zeros((2, 2))
    sums = [np.full_like(emit, 1e-6), np.full_like(step, 1e-6)]
    for _ in range(rounds):
        e = np.stack([np.bincount(row, emit[col, y], s * t) for y in (0, 1)], 1).reshape(s, t, 2)
        fore, aft = np.zeros((s, t, 2)), np.zeros((s, t, 2))
        fore[:, 0] = e[:, 0]
        for j in range(1, t):
            moved = np.logaddexp.reduce(fore[:, j - 1, :, None] + step, 1) + e[:, j]
            fore[:, j] = np.where(there[:, j, None], moved, fore[:, j - 1])
        for j in range(t - 2, -1, -1):
            moved = np.logaddexp.reduce(step + (e[:, j + 1] + aft[:, j + 1])[:, None, :], 2)
            aft[:, j] = np.where(there[:, j + 1, None], moved, 0)
        whole = np.logaddexp.reduce(fore[:, -1], 1)
        single = np.exp(fore + aft - whole[:, None, None]) * there[..., None]
        double = np.exp(fore[:, :-1, :, None] + step + (e[:, 1:] + aft[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * there[:, 1:, None, None]
        apart = (truth - single).reshape(-1, 2)
        g_emit = np.stack([np.bincount(col, apart[row, y], len(index)) for y in (0, 1)], 1) / s - decay * emit
        g_step = (pair - double.sum((0, 1))) / s - decay * step
        for w, g, total in zip((emit, step), (g_emit, g_step), sums, strict=True):
            total += g * g
            w += 0.3 * g / np.sqrt(total)
    return Field(index, emit, step)


def labelled_pages(count: int = PAGES, seed: int = 5) -> list[str]:
    """Pages of many layouts; elements of the article carry the mark ``data-main="1"``."""
    r = random.Random(seed)
    syllables = "an en er on in th re st ou ti de la le que ch ie un be os ra co ment tion ung".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentence(a: int = 3, b: int = 25) -> str:
        return words(a, b).capitalize() + r.choice("..,.!?")

    def prose() -> str:
        return " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 9))))

    def name(*options: str) -> str:
        return r.choice(("class", "class", "id")) + f'="{r.choice(options)}"'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def menu() -> str:
        return r.choice((f"<nav>{links(r.randint(2, 9))}</nav>", f'<div {name("menu", "nav", "navbar", "navigation", "top-nav", "main-menu")}>{links(r.randint(2, 9))}</div>',
                         f'<div {name("breadcrumb", "breadcrumbs")}><a href="/">{word()}</a> &gt; <a href="/x">{word()}</a></div>'))

    def head() -> str:
        return r.choice((f"<header><h1>{words(1, 4)}</h1><p>{sentence(2, 8)}</p></header>", f'<div {name("header", "site-header", "masthead", "topbar")}><a href="/">{words(1, 3)}</a> {words(1, 6)}</div>', f"<header>{menu()}</header>", ""))

    def advert() -> str:
        body = r.choice((sentence(), f"<p>{prose()}</p>", f'<a href="/b">{words(2, 8)}</a>', f"{sentence()}\n{sentence(1, 4)}"))
        return f'<div {name("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "ad-box")}>{body}</div>'

    def notice() -> str:
        return f'<div {name("cookie", "cookie-banner", "notice", "alert", "consent", "gdpr", "popup", "modal", "site-notice")}><p>{r.choice(("We use cookies.", "", "Please accept cookies."))} {sentence(2, 14)}</p>{r.choice(("<button>OK</button>", ""))}</div>'

    def side() -> str:
        body = r.choice((f"<h3>{words(1, 3)}</h3>{links(r.randint(2, 6))}", f"<p>{prose()}</p>", f"<h4>{words(1, 3)}</h4><p>{sentence()}</p>"))
        return r.choice((f"<aside>{body}</aside>", f'<div {name("sidebar", "side", "widget", "related", "recommended", "right-column", "popular", "more-stories")}>{body}</div>'))

    def form() -> str:
        return f'<form {name("search", "newsletter", "subscribe", "login", "contact")}><label>{words(1, 4)}</label><input name="q"><p>{sentence(2, 9)}</p><select><option>{word()}</option></select><button>{word()}</button></form>'

    def share() -> str:
        return f'<div {name("share", "social", "tags", "toolbar", "pagination", "author-links")}>{links(r.randint(2, 4))}</div>'

    def remarks() -> str:
        one = lambda: r.choice((f'<li class="comment"><p>{prose()}</p></li>', f'<div class="comment"><b>{word()}</b><p>{prose()}</p><a href="#">Reply</a></div>', f'<article class="comment"><p>{prose()}</p></article>'))
        body = f"<h3>{r.choice(('Comments', words(1, 2)))}</h3>" + "".join(one() for _ in range(r.randint(1, 5)))
        return r.choice((f'<section {name("comments", "reader-comments", "responses", "discussion")}>{body}</section>', f'<div {name("comments", "comment-list", "disqus", "replies")}>{body}</div>', f'<ol class="commentlist">{body}</ol>'))

    def foot() -> str:
        return r.choice((f"<footer>&copy; {word()}.com &middot; {sentence(1, 12)}</footer>", f'<div {name("footer", "site-footer", "bottom", "legal", "copyright")}><p>&copy; {words(1, 5)}</p>{r.choice(("", links(3), f"<p>{sentence()}</p>"))}</div>', f"<footer><p>{prose()}</p>{links(3)}</footer>"))

    def piece() -> str:
        if r.random() < 0.12:
            return f"<p><b>{prose()}<br>"
        return r.choice((*[f"<p>{prose()}</p>"] * 8, f"<h2>{words(1, 7)}</h2>", f"<ul><li>{sentence()}</li><li>{words(1, 9)}</li></ul>", f"<blockquote><p>{prose()}</p></blockquote>", f"<pre>{words(2, 9)}</pre>", f"<div>{prose()}</div>",
                         f"<table><tr><td>{words(1, 4)}</td><td>{word()}</td></tr></table>", f'<figure><img src="x"><figcaption>{sentence(2, 9)}</figcaption></figure>', f'<p>{sentence()} <a href="/y">{words(1, 4)}</a> {sentence()}</p>', f"<h3>{words(1, 5)}</h3>"))

    def article() -> str:
        title = r.choice((f"<h1>{words(2, 12)}{r.choice(('', '.'))}</h1>", f"<header><h1>{words(2, 12)}</h1></header>", f"<h1>{words(2, 9)}</h1><p class=\"{r.choice(('lead', 'intro', 'summary'))}\">{prose()}</p>"))
        parts = [title, *[piece() for _ in range(r.choice((1, 1, 2, 4, 8, 14)))]]
        body = []
        for p in parts:
            body.append(p)
            if r.random() < 0.06:
                body.append("</MAIN>" + r.choice((advert, share, side, form))() + "<MAIN>")
        inner = "<MAIN>" + "".join(body) + "</MAIN>" + (share() if r.random() < 0.15 else "") + (remarks() if r.random() < 0.12 else "")
        # a mark has no element of its own: it is put on every element between the two
        marked = "".join(re.sub(r"<(?=[a-z])([a-z0-9]+)", r'<\1 data-main="1"', x[6:]) if x.startswith("<MAIN>") else x.replace("</MAIN>", "") for x in re.split(r"(?=<MAIN>|</MAIN>)", inner))
        outer = r.choice(("article", "article", "article", "main", 'div class="content"', 'div class="post"', 'div id="content"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'div class="main-text"', 'div id="main"', 'div class="post-content"'))
        whole = f"<{outer}>{marked}</{outer.split()[0]}>"
        return r.choice((whole, whole, f"<main>{whole}</main>", f'<div class="wrapper">{whole}</div>', f'<div id="page"><div class="container">{whole}</div></div>'))

    out = []
    for _ in range(count):
        before = [x() for x in (notice, head, menu, advert, form, side) if r.random() < 0.4]
        after = [x() for x in (share, side, remarks, advert, form, menu) if r.random() < 0.3] + ([foot()] if r.random() < 0.85 else [])
        r.shuffle(before)
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var a;</script></head><body>{''.join(before)}{article()}{''.join(after)}</body></html>")
    return out


@lru_cache(1)
def model() -> Field:
    """Fitted once a process, on labelled pages alone."""
    pages = [blocks(p) for p in labelled_pages()]
    return fit([(features(p), [int(b.main) for b in p]) for p in pages])


def main_text(page: str | None, field: Field) -> str:
    page_blocks = blocks(page or "")
    return "\n".join(b.text for b, y in zip(page_blocks, field.decode(features(page_blocks)), strict=True) if y)


def extract(pages: DataFrame, keep: list[str], page: str = "html", field: Field | None = None) -> DataFrame:
    """``keep`` with ``text`` and ``n_chars`` of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(field or model())

    def text(batches):
        for batch in batches:
            texts = [main_text(p, shared.value) for p in batch[len(keep)].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[i] for i in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"
    return small(pages).select(*keep, page).mapInArrow(text, schema)
