"""Leaf blocks of a page: their text, tag, ancestors and how much of them is link text."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is not text of the page
SKIPPED = frozenset("script style template iframe noscript textarea title svg math object noembed noframes xmp".split())
#: a start tag on the left ends an open element on the right
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_NOT_P = BLOCK - {"p"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_OPEN_END = re.compile(r"<(?:[a-zA-Z/!?][^>]*)?\Z")
_ATTR = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARK = re.compile(r"data-main\s*=\s*\"1\"")


@dataclass
class Block:
    text: str
    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    depth: int
    link_chars: int = 0
    main: bool = False


@dataclass
class _Open:
    """An open element, with what holds for all open elements up to it."""

    tag: str
    block: str
    tags: frozenset[str]
    names: frozenset[str]
    linked: bool
    main: bool


_PAGE = _Open("", "", frozenset(), frozenset(), False, False)


@dataclass
class _State:
    stack: list[_Open] = field(default_factory=list)
    #: how many elements of a tag are open
    open: Counter[str] = field(default_factory=Counter)
    text: list[str] = field(default_factory=list)
    linked: int = 0
    blocks: list[Block] = field(default_factory=list)

    @property
    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _PAGE

    def push(self, tag: str, names: tuple[str, ...], main: bool) -> None:
        up = self.top
        # sets are shared with the element around unless they grow, so deep nesting copies nothing
        self.stack.append(_Open(tag, tag if tag in BLOCK else up.block, up.tags if tag in up.tags else up.tags | {tag}, up.names if up.names.issuperset(names) else up.names.union(names),
                                up.linked or tag == "a", up.main or main))
        self.open[tag] += 1

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            e = self.top
            self.blocks.append(Block(text, e.block, e.tags, e.names, len(self.stack), self.linked, e.main))
        self.text, self.linked = [], 0

    def close(self, tags: frozenset[str] | set[str], scope=frozenset()) -> None:
        """Close the innermost open element of ``tags``, not looking beyond ``scope``."""
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in tags:
                for e in self.stack[i:]:
                    self.open[e.tag] -= 1
                del self.stack[i:]
                return
            if self.stack[i].tag in scope:
                return


def blocks(page: str) -> list[Block]:
    """In page order; white space in a block is one space, character references are decoded."""
    s, at, end = _State(), 0, len(page)
    # no tag ends after the last >, so none is looked for there
    last = page.rfind(">") + 1
    cut = _OPEN_END.search(page, max(0, page.rfind("<")))
    if cut:
        end = cut.start()
    while at < end:
        m = _TOKEN.search(page, at, last)
        if m:
            stop = m.start()
        else:
            comment = page.find("<!--", at, end)
            stop = comment if comment >= 0 else end
        if stop > at:
            text = html.unescape(page[at:stop])
            s.text.append(text)
            if s.top.linked:
                s.linked += len(text)
        # a comment that no --> ends hides the rest of the page
        if not m or m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")):
            break
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                s.flush()
            s.close({tag})
            continue
        if tag in BLOCK:
            s.flush()
            if tag in ENDS:
                s.close(ENDS[tag], SCOPE[tag])
            s.close({"p"}, _NOT_P)
        elif tag == "br":
            s.text.append(" ")
        if tag in SKIPPED:
            if not attrs.rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = over.end() if over else end
            continue
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            names = tuple(n.lower() for a in _ATTR.finditer(attrs) for n in _NAME.findall(a[1] or a[2] or a[3] or "")) if attrs else ()
            s.push(tag, names, bool(attrs) and bool(_MARK.search(attrs)))
    s.flush()
    return s.blocks
