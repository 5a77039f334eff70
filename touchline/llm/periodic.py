"""Periodic runs of words by an enhanced suffix array, without tree nodes.

A run is a longest stretch of words with smallest period q. Of interest are runs of at least ``copies`` periods and
``least`` words. For each piece of text:

1. Suffixes are sorted by prefix doubling; the ranks of every doubling stay and give the LCP table.
2. Each entry of the LCP table parts its interval in two. The suffixes i of the smaller part look up ISA[i + depth] and
   ISA[i - depth]: if that is in the other part, a square of period ``depth`` starts there whose next word breaks the
   period. Squares with ISA of the periods before them outside the interval are too short for a run of ``copies`` periods.
3. Squares are rotated to the left as far as their period holds, 2^l words at a time by the ranks. Of squares with one end
   the shortest is primitive; longer ones that repeat it inside its run are the same run and merge into it.

Words whose 4-grams are all unique in a text are in no run, so only stretches of repeated 4-grams are sorted. Rows are
independent: nothing is shuffled, and a task holds one batch of texts or one long text (some 200 bytes a repeated word).
Words are told apart by 64-bit hashes.

Defined cases: a null, empty or blank text has no words and no run; very long texts are read whole; repeated rows
are rows each; an empty table gives no row; all columns are kept, a column named as a result is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchline.llm import words
from touchline.llm.batches import small

COPIES, LEAST = 4, 6
#: words of a gram that recurs inside a run of COPIES periods and LEAST words, wherever it starts there
GRAM = 4
#: suffixes looked up at once
LOOKUPS = 1 << 20

RESULT = ("n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string")


class Suffixes:
    """Suffix array ``sa``, its inverse ``isa`` and ``lcp`` (of each entry with the one before; -1 at both ends) of integers that end in a unique one."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        sa = np.argsort(s, kind="stable").astype(np.int64)
        self.ranks = [self._ranked(sa, np.append(True, np.diff(s[sa]) != 0), np.zeros(n, np.int32), np.arange(n))]
        at = self._open(np.append(True, np.diff(s[sa]) != 0), np.arange(n))
        width = 1
        while len(at):
            rank, part = self.ranks[-1], sa[at]
            first, second = rank[part], rank[part + width]
            order = np.lexsort((second, first))
            part = sa[at] = part[order]
            first, second = first[order], second[order]
            new = np.append(True, (np.diff(first) != 0) | (np.diff(second) != 0))
            self.ranks.append(self._ranked(part, new, rank.copy(), at))
            at = self._open(new, at)
            width *= 2
        self.sa, self.isa = sa, self.ranks[-1]
        self.lcp = np.full(n + 1, -1, np.int64)
        i, j, same = sa[:-1], sa[1:], np.zeros(max(n - 1, 0), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            near = np.maximum(i, j) + same < n
            same += np.where(near, rank[np.minimum(i + same, n - 1)] == rank[np.minimum(j + same, n - 1)], False).astype(np.int64) << level
        self.lcp[1:n] = same

    @staticmethod
    def _ranked(suffixes, new, rank, at):
        """``rank`` with the place where its group begins for each of ``suffixes``, which are at ``at``."""
        rank[suffixes] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        return rank

    @staticmethod
    def _open(new, at):
        """Places of groups of several suffixes."""
        return at[~(new & np.append(new[1:], True))]

    def back(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Where the period that holds from ``at`` on begins."""
        at = at.copy()
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, to = self.ranks[level], at - (1 << level)
            at = np.where((to >= 0) & (rank[np.maximum(to, 0)] == rank[np.maximum(to, 0) + period]), to, at)
        return at


def _before(lcp: np.ndarray, equal: bool) -> np.ndarray:
    """For each entry the nearest one before it that is smaller, or smaller or ``equal``."""
    p = np.arange(-1, len(lcp) - 1)
    live = np.arange(1, len(lcp) - 1)
    while len(live):
        low, own = lcp[p[live]], lcp[live]
        live = live[low > own if equal else low >= own]
        p[live] = p[p[live]]
    return p


def _squares(t: Suffixes, longest: int):
    """Starts and periods of squares whose next word breaks the period, and before which two more periods lie."""
    lcp, n = t.lcp, len(t.sa)
    begin = _before(lcp, equal=False)
    left = _before(lcp, equal=True)
    end = len(lcp) - 1 - _before(lcp[::-1], equal=False)[::-1]
    node = np.arange(len(lcp))
    some = np.flatnonzero((lcp >= 1) & (COPIES * lcp <= longest) & (end - begin >= COPIES))
    fewer = np.minimum(node - left, end - node)[some]
    upto = np.cumsum(fewer)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(some):
        # at least one entry at a time, so that a large one is looked up whole
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LOOKUPS, "right")))
        k, m = some[at:to], fewer[at:to]
        own_left = k - left[k] <= end[k] - k
        low = np.where(own_left, left[k], k)
        other = np.where(own_left, k, left[k]), np.where(own_left, end[k], k)
        i = t.sa[np.repeat(low - np.cumsum(m) + m, m) + np.arange(m.sum())]
        depth = np.repeat(lcp[k], m)
        for j in (i + depth, i - depth):
            place = np.where((j >= 0) & (j < n), t.isa[np.clip(j, 0, n - 1)], -1)
            hit = np.flatnonzero((place >= np.repeat(other[0], m)) & (place < np.repeat(other[1], m)))
            first, period, of = np.minimum(i, j)[hit], depth[hit], np.repeat(k, m)[hit]
            for back in range(1, COPIES - 1):
                place = np.where(first >= back * period, t.isa[np.maximum(first - back * period, 0)], -1)
                keep = (place >= begin[of]) & (place < end[of])
                first, period, of = first[keep], period[keep], of[keep]
            starts.append(first)
            periods.append(period)
        at = to
    return np.concatenate(starts), np.concatenate(periods)


def _runs(t: Suffixes, longest: int):
    """start, end, period of each run, in order of end and period."""
    first, period = _squares(t, longest)
    end = first + 2 * period
    order = np.lexsort((period, end))
    first, period, end = first[order], period[order], end[order]
    found = []
    while len(first):
        shortest = np.append(True, np.diff(end) != 0)
        group = np.cumsum(shortest) - 1
        q, e = period[shortest], end[shortest]
        start = t.back(first[shortest], q)
        found.append((start, e, q))
        same = (period % q[group] == 0) & (2 * period <= e[group] - start[group])
        first, period, end = first[~same], period[~same], end[~same]
    return [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 3)]


def runs_of(w: words.Words):
    """text, start (word of the text), length, period of all runs of some texts, in order of text, start and period."""
    none = (np.zeros(0, np.int64),) * 4
    if len(w.hash) < LEAST:
        return none
    # words of different texts differ, so that copies of a text do not lengthen what they share
    own = words.mix(w.hash + w.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    gram = words.ngrams(own, GRAM)
    order = np.argsort(gram)
    same = np.diff(gram[order]) == 0
    again = np.zeros(len(gram) + 2, bool)
    again[order + 1] = np.append(same, False) | np.append(False, same)
    again[1:-1] &= words.inside(w.text, GRAM)
    edge = np.flatnonzero(again[1:] != again[:-1]).reshape(-1, 2)
    edge = edge[edge[:, 1] - edge[:, 0] + GRAM - 1 >= LEAST]
    if not len(edge):
        return none
    size = edge[:, 1] - edge[:, 0] + GRAM - 1
    begin = np.cumsum(size + 1) - size - 1
    word = np.repeat(edge[:, 0] - begin, size + 1) + np.arange(begin[-1] + size[-1] + 1)
    stop = begin + size
    word[stop] = 0
    s = np.unique(own[word], return_inverse=True)[1].astype(np.int64)
    s[stop] = len(s) + np.arange(len(stop))
    start, end, period = _runs(Suffixes(s), int(size.max()))
    length = end - start
    keep = (length >= LEAST) & (length >= COPIES * period)
    start, length, period = word[start[keep]], length[keep], period[keep]
    text = w.text[start]
    start = start - w.first[text]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _kept(length: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``length`` words no run holds after its first period."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` by start and period, and ``collapsed``: the words that are in no run after its first period, joined by one space."""
    names = docs.columns
    clash = [r for r in RESULT if r.split()[0] in names]
    if clash:
        raise ValueError(f"columns of these names are results: {clash}")
    at = names.index(text)

    def found(batches):
        for batch in batches:
            texts = words.encoded(batch[at])
            n_words, n_runs, collapsed, parts = [], [], [], []
            for a, b in words.chunks(texts):
                w = words.Words(texts[a:b])
                own, start, length, period = runs_of(w)
                runs = np.stack([start, length, period], axis=1)
                parts.append(runs)
                edge = np.searchsorted(own, np.arange(b - a + 1))
                n_words.append(np.diff(w.first))
                n_runs.append(np.diff(edge))
                for i, t in enumerate(texts[a:b]):
                    pieces = t.split()
                    if edge[i + 1] > edge[i]:
                        keep = _kept(len(pieces), runs[edge[i]:edge[i + 1]])
                        pieces = [pieces[k] for k in np.flatnonzero(keep).tolist()]
                    collapsed.append(b" ".join(pieces))
            runs = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
            offset = np.append(0, np.cumsum(np.concatenate(n_runs) if n_runs else [])).astype(np.int32)
            fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs.T], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.ListArray.from_arrays(pa.array(offset), fields), pa.array(collapsed, pa.binary()).cast(pa.string())],
                                             names=[*names, *(r.split()[0] for r in RESULT)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *RESULT])
    return small(docs).mapInArrow(found, schema)
