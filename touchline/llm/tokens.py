"""Token ids of many texts at once for a byte-level BPE vocabulary file.

The ids are those of ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
Texts are cut into the vocabulary's pieces in numpy; each distinct piece is merged once by
``tiktoken`` over the same vocabulary and looked up afterwards.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np

from touchline.llm import words

#: fixed values of the byte-level vocabulary: white space, contraction endings, the text that is one special id
BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LETTER, _NUMBER, _OTHER, _BLANK = range(4)
#: places of the direct-mapped table and ids held before it is emptied
SLOTS, HELD = 1 << 20, 1 << 23


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    text = "".join(map(chr, points))
    at = np.array(points)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            table[at[m.start():m.end()]] = kind
    table[BLANKS] = _BLANK
    return table


def _bytes_of() -> dict[str, int]:
    """The vocabulary file writes printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        place = _bytes_of()
        ranks = {bytes(place[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.special = list(special)
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.point_hash = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._empty()

    def _empty(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int64)
        self.size = np.zeros(SLOTS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _held(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = self.used
        self.ids[at:at + len(ids)] = ids
        self.used += len(ids)
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = np.array(self.bpe.encode(t, allowed_special="all"), np.uint32)
            else:
                plain.append(i)
        some = [texts[i] for i in plain]
        for a, b in _ranges(some):
            for i, ids in zip(plain[a:b], self._encode(some[a:b]), strict=True):
                out[i] = ids
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32)] * len(texts)
        if self.used > HELD:
            self._empty()
        point = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=begin[1:])
        cut = _starts(point, begin)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(point))
        up, down = words._Powers.upto(len(point) + 1)
        total = np.zeros(len(point) + 1, np.uint64)
        np.cumsum(self.point_hash[point] * up[:len(point)], out=total[1:])
        h = words.mix((total[ends] - total[starts]) * down[starts])
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        at, size = self.at[slot], self.size[slot].astype(np.int64)
        miss = np.flatnonzero((self.key[slot] != h) | (size == 0))
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            got = [self.bpe.encode_ordinary(joined[starts[i]:ends[i]]) for i in miss[first]]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            places = self._held(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))) + np.cumsum(sizes) - sizes
            at[miss], size[miss] = places[back], sizes[back]
            into = (new & np.uint64(SLOTS - 1)).astype(np.int64)
            # pieces that meet in one place: the last of each place stays, all three arrays from the same piece
            _, keep = np.unique(into[::-1], return_index=True)
            keep = len(into) - 1 - keep
            self.key[into[keep]], self.at[into[keep]], self.size[into[keep]] = new[keep], places[keep], sizes[keep]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ids = self.ids[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])]
        edge = upto[np.searchsorted(starts, begin)]
        return [ids[edge[i]:edge[i + 1]] for i in range(len(texts))]


def _ranges(texts: list[str]):
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > words.CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _starts(point: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where a piece begins: runs of one class, with one space in front where there is one."""
    n = len(point)
    kind = _classes()[point]
    edge = np.zeros(n + 1, bool)
    edge[begin] = True
    edge[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(edge)
    rs, re = run[:-1], run[1:]
    text_start = np.zeros(n + 1, bool)
    text_start[begin] = True
    blank = kind[rs] == _BLANK
    cut = np.zeros(n + 1, bool)
    cut[rs] = True
    # a run of blanks before something else gives up its last one
    led = blank & ~text_start[re]
    cut[re[led] - 1] = True
    joined = led & (point[re - 1] == 0x20)
    cut[re[joined]] = False
    # an apostrophe that begins a piece takes an ending with it
    lone = np.flatnonzero((point[rs] == 0x27) & cut[rs] & (re - rs == 1) & ~text_start[re])
    for r in lone:
        s, e = re[r], run[r + 2] if r + 2 < len(run) else n
        word = "".join(map(chr, point[s:min(e, s + 2)].tolist()))
        k = next((len(x) for x in ENDINGS if word.startswith(x)), 0)
        if k:
            cut[s] = False
            cut[s + k] = True
    return cut[:n]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per Python worker; its tables are bounded by SLOTS and HELD."""
    return Encoder(path)
