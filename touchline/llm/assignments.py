"""Secret scans by assignment-aware lexing.

Three patterns give the base spans (``assign``, ``access``, ``hex``). Texts with a sensitive word are lexed besides: strings, words,
operators, brackets and line ends of source and configuration files. From the tokens come pairs of a target and its value:
``name = value``, ``name: value``, ``name: type = value``, ``"key": value``, ``config["key"] = value``, ``key => value``,
``--name=value``, ``<name>value</name>``, ``set_name("value")``, ``put("key", "value")``. A value is literals and names joined by
``+``; a name stands for all literals assigned to it anywhere in the text, through any number of names. A literal's score is
the most sensitive target it reaches times how much it looks like a secret; from THRESHOLD on it is a ``literal`` span, unless a
base span holds it.

Rows are independent: nothing is shuffled, and a task holds one batch of texts. Lexing and propagation are linear in the text.

Defined cases: a null, empty or blank text has no span; very long texts are read whole; repeated rows are rows each; an
empty table gives no row; all columns are kept, a column ``spans`` is an error. Places are code points.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm.batches import small

#: kinds in the order of equal starts
KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
# maximal runs, so a least length in the pattern is the same as dropping shorter matches
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: how sensitive a word of a target's name is
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
             "credentials": 0.9, "bearer": 0.8, "auth": 0.7, "authorization": 0.8, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signingkey": 1.0}
#: words before ``key`` that make it sensitive
KEYS = ("api", "access", "private", "secret", "signing", "encryption", "master", "account", "storage")
#: last words that name a property of the secret, not the secret
PROPERTIES = ("type", "name", "field", "label", "hint", "url", "uri", "path", "file", "length", "size", "count", "id", "expiry", "ttl", "regex", "prefix", "policy", "header", "version")
PLACEHOLDERS = re.compile(r"(?i)change.?me|example|placeholder|dummy|redacted|your[_ -]|<.*>|^[*x.]+$|^(none|null|true|false|undefined|password|secret|token)$")

#: one of these is in every sensitive name, and in every base assignment
_MAYBE = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
#: bytes of hexadecimal digits as one byte
_DIGITS = bytes(ord("0") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
_TOKEN = re.compile(r"""
    (?P<text>"(?:[^"\\\n]|\\.)*"|(?<!\w)'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
  | (?P<name>[$@]?(?:--)?[^\W\d]\w*(?:[.-][^\W\d]\w*)*)
  | (?P<op>:=|=>|->|[=!<>]=|[=:+])
  | (?P<line>\n)
  | (?P<mark>[^\s])
""", re.VERBOSE)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> float:
    """0 to 1 by the words of a name in any case style."""
    parts = [p.lower() for p in _WORD.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if any(a in KEYS and b in ("key", "keys") for a, b in zip(parts, parts[1:], strict=False)):
        best = 1.0
    return best * 0.3 if parts and parts[-1] in PROPERTIES else best


def strength(value: str, quoted: bool) -> float:
    """0 to 1: length, kinds of characters and their entropy; placeholders and references are 0."""
    if len(value) < (6 if quoted else 8) or PLACEHOLDERS.search(value) or re.search(r"\$\{|\{\{|%\(|\s", value):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]"))
    if not quoted and not re.search("[0-9]", value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, 0.25 + 0.15 * kinds + 0.1 * entropy) if kinds > 1 or entropy >= 3 else 0.4


class _Lexed:
    """Tokens (kind, start, end) of a text and the pairs of targets and values found in them."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text)]
        #: name -> literals (start, end, quoted), and name -> names it is made of
        self.literals: dict[str, list[tuple[int, int, bool]]] = defaultdict(list)
        self.names: dict[str, list[str]] = defaultdict(list)
        #: unquoted words that are literals unless they are names assigned elsewhere
        self.bare: list[tuple[str, int, int]] = []
        i = 0
        while i < len(self.tokens):
            i = max(i + 1, self._statement(i))
        for target, start, end in self.bare:
            word = text[start:end].strip("$")
            if word in self.literals or word in self.names:
                self.names[target].append(word)
            else:
                self.literals[target].append((start, end, False))

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else "line"

    def says(self, i: int) -> str:
        return self.text[self.tokens[i][1]:self.tokens[i][2]] if 0 <= i < len(self.tokens) else "\n"

    def target(self, i: int) -> str | None:
        """Name of a target that token i is: a word, or the words of a quoted key."""
        if self.kind(i) == "name":
            return self.says(i).lstrip("$@-")
        if self.kind(i) == "text" and re.fullmatch(r"[\w.$ -]{1,80}", self.says(i)[1:-1]):
            return self.says(i)[1:-1]
        return None

    def _statement(self, i: int) -> int:
        """Reads a pair that begins at token i, if any; the token after it."""
        name = self.target(i)
        if name is None:
            return i + 1
        after = i + 1
        if self.kind(i) == "text" and self.says(after) == "]":
            after += 1
        said = self.says(after)
        if said == ":" and self.kind(after + 1) == "name" and self.says(after + 2) == "=":
            return self._value(name, after + 3)  # a type between
        if said in ("=", ":", ":=", "=>"):
            return self._value(name, after + 1)
        if said == "," and self.kind(i) == "text" and self.kind(after + 1) == "text":
            return self._value(name, after + 1)
        if said == "(" and self.kind(i) == "name" and self.kind(after + 1) == "text" and self.says(after + 2) == ")":
            return self._value(name, after + 1)
        if said == ">" and self.says(i - 1) == "<":
            return self._value(name, after + 1)
        return i + 1

    def _value(self, name: str, i: int) -> int:
        """Literals and names joined by + from token i on."""
        while True:
            kind = self.kind(i)
            start, end = self.tokens[i][1:] if i < len(self.tokens) else (0, 0)
            if kind == "text":
                self.literals[name].append((start + 1, end - 1, True))
                end_at = i + 1
            elif kind in ("name", "mark", "op") and (m := _BARE.match(self.text, start)):
                end_at = i + 1
                while end_at < len(self.tokens) and self.tokens[end_at][1] < m.end():
                    end_at += 1
                if self.says(end_at) in ("(", "["):  # a call or a lookup
                    return i + 1
                if self.says(end_at) in ("=", ":", ":=", "=>") and kind == "name":
                    return i  # another target
                self.bare.append((name, m.start(), m.end()))
            else:
                return i
            if self.says(end_at) != "+":
                return end_at
            i = end_at + 1

    def scored(self):
        """start, end, target, score of each literal, by the most sensitive target it reaches."""
        best: dict[tuple[int, int, bool], tuple[float, str]] = {}
        done: set[str] = set()
        # the most sensitive targets first: what they reach is settled once
        for weight, target in sorted(((sensitivity(t), t) for t in {*self.literals, *self.names}), reverse=True):
            if weight <= 0:
                break
            todo = [target]
            while todo:
                name = todo.pop()
                if name in done:
                    continue
                done.add(name)
                for literal in self.literals.get(name, ()):
                    best.setdefault(literal, (weight, target))
                todo.extend(self.names.get(name, ()))
        for (start, end, quoted), (weight, target) in best.items():
            yield start, end, target, weight * strength(self.text[start:end], quoted)


def spans_of(text: str) -> list[tuple[str, int, int, str | None, float]]:
    """kind, start, end, target, score of every span, by start and kind."""
    found: list[tuple[str, int, int, str | None, float]] = []
    low = text.lower()
    # finding a plain string is many times as fast as a pattern
    maybe = any(word in low for word in _MAYBE)
    if maybe:
        found += [("assign", *m.span(), m[1], 1.0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span(), None, 1.0) for m in _ACCESS.finditer(text)]
    if b"0" * 32 in text.encode("utf-8", "surrogatepass").translate(_DIGITS):
        found += [("hex", *m.span(), None, 1.0) for m in _HEX.finditer(text)]
    if maybe:
        base = sorted(f[1:3] for f in found)
        # the furthest end of base spans up to each start
        ends = list(accumulate((end for _, end in base), max))
        for start, end, target, score in _Lexed(text).scored():
            at = bisect_right(base, (start, len(text) + 1)) - 1
            if score >= THRESHOLD and not (at >= 0 and ends[at] >= end):
                found.append(("literal", start, end, target, round(score, 4)))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: kind, start, end (exclusive), target and score of each span, by start and kind."""
    names = docs.columns
    if "spans" in names:
        raise ValueError("a column of this name is the result: spans")
    at = names.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("target", pa.string()), ("score", pa.float64())]))

    def found(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "target", "score"), s, strict=True)) for s in spans_of(t)] if t else [] for t in batch[at].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*names, "spans"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "spans array<struct<kind:string,start:long,end:long,target:string,score:double>>"])
    return small(docs).mapInArrow(found, schema)
