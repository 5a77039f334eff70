"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from the labelled rows: words and word stems whose share among toxic texts is well above
that among others. Counts by hash bucket come first, exact counts of what is in a promising bucket second, so the
vectors and the lexicon have fixed bounds. Features of a text are densities of lexicon words and stems, their
nearness to second-person words, and rates of capitals, punctuation, digits and words broken by symbols. Two of three
learning rows fit the trees, the third the calibration, a monotone step function over thousandths.

Defined cases: null, empty and wordless texts have the features of an empty text and its score; very long texts
are read whole; without labelled rows of both kinds every score is the share of toxic labels, 0 without labels; rows with one id
each get their own score, and a label counts for each; labels that are null are left out; a null id is scored and never learned from; further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import words
from touchline.llm.batches import small
from touchline.llm.dense import summed
from touchline.session import stage

#: counters of units by bucket, most units of the lexicon, rows of labels that are broadcast
COUNTERS, LEXICON, BROADCAST_LABELS = 1 << 18, 20_000, 2_000_000
STEMS = (4, 5)
NEAR = 6
#: second-person words of the languages learned so far
YOU = ("you", "your", "yours", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "te", "toi", "ton", "vous", "votre", "tú", "ti", "tus", "usted", "ustedes", "vosotros")
FEATURES = ("word_density", "word_hits", "stem_density", "stem_hits", "strongest", "mean_weight", "near_you", "capitals", "loud", "punctuation", "broken", "digits", "length")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NOT_LETTER = ~_LETTER
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOUD = np.zeros(256, bool)
_LOUD[[ord("!"), ord("?")]] = True
_BLANK = words.SPACE
_MARK = ~_LETTER & ~_DIGIT & ~_BLANK
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


class Units:
    """Words of some texts and their stems, each a hash."""

    def __init__(self, texts: list[bytes]):
        self.words = w = words.Words(texts, words.LOWER, _NOT_LETTER)
        size = w.ends - w.starts
        self.stems = []
        for n in STEMS:
            h = words.span_hash(w.data, w.starts, np.minimum(w.starts + n, w.ends)) ^ np.uint64(n)
            self.stems.append(np.where(size > n, h, np.uint64(0)))
        self.all = [w.hash, *self.stems]


def _toxic_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    known = labels.filter(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    few = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known) if few else known, "id")


def lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights (log ratio) of the units that mark toxic texts; ``rows`` have ``text`` and ``toxic``."""
    def batches_of(batches):
        for batch in batches:
            toxic, texts = np.array(batch[1].to_pylist(), np.int64), words.encoded(batch[0])
            for a, b in words.chunks(texts):
                u = Units(texts[a:b])
                for h in u.all:
                    some = h != 0
                    row = u.words.text[some]
                    # a unit counts once a text
                    pair = np.unique(np.stack([row.astype(np.uint64), h[some]], 1), axis=0) if len(row) else np.zeros((0, 2), np.uint64)
                    yield pair[:, 1], toxic[a:b][pair[:, 0].astype(np.int64)]

    def count(batches):
        total = np.zeros(2 * COUNTERS, np.int64)
        for h, y in batches_of(batches):
            slot = (h & np.uint64(COUNTERS - 1)).astype(np.int64)
            total += np.bincount(slot + COUNTERS * y, minlength=2 * COUNTERS)
        return total

    rows = rows.select("text", "toxic")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return np.zeros(0, np.uint64), np.zeros(0)
    least = max(3, bad // 1000)
    total = summed(rows, count, 2 * COUNTERS).reshape(2, COUNTERS)
    promising = (total[1] >= least) & (total[1] / bad > 1.5 * total[0] / good)
    shared = rows.sparkSession.sparkContext.broadcast(promising)

    def exact(batches):
        for h, y in batches_of(batches):
            keep = shared.value[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
            new, back = np.unique(h[keep], return_inverse=True)
            n = np.bincount(back, minlength=len(new))
            t = np.bincount(back, weights=y[keep], minlength=len(new)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(t), pa.array(n - t)], names=["h", "bad", "good"])

    counts = rows.mapInArrow(exact, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    weight = F.log((F.col("bad") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(good + 1.0))
    top = counts.filter(F.col("bad") >= least).withColumn("w", weight).filter("w > 2").orderBy(F.desc("w"), "h").limit(LEXICON).collect()
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    at = np.argsort(h)
    return h[at], np.array([r["w"] for r in top])[at]


def features(docs: DataFrame, lex: tuple[np.ndarray, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the FEATURES of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def describe(batches):
        known, weight = shared.value
        you = words.Words([y.encode() for y in YOU], words.LOWER, _NOT_LETTER).hash
        for batch in batches:
            texts = words.encoded(batch[len(keep)])
            parts = [_describe(texts[a:b], known, weight, you) for a, b in words.chunks(texts)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*[batch[i] for i in range(len(keep))], *[pa.array(c) for c in x.T]], names=[*keep, *FEATURES])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + "".join(f", {f} double" for f in FEATURES)
    return small(docs).select(*keep, text).mapInArrow(describe, schema)


def _describe(texts: list[bytes], known: np.ndarray, weight: np.ndarray, you: np.ndarray) -> np.ndarray:
    u, n = Units(texts), len(texts)
    w = u.words
    sizes = np.maximum(np.diff(w.first), 1)

    def weights(h):
        if not len(known):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, weight[at], 0.0)

    def by_text(values):
        return np.bincount(w.text, weights=values, minlength=n)

    own = weights(w.hash)
    stem = np.max([weights(h) for h in u.stems], axis=0) if len(w.hash) else own
    best = np.maximum(own, stem)
    strongest = np.zeros(n)
    np.maximum.at(strongest, w.text, best)
    near = np.zeros(len(w.hash) + 1)
    hit = np.flatnonzero(np.isin(w.hash, you))
    np.add.at(near, np.maximum(hit - NEAR, w.first[w.text[hit]]), 1)
    np.add.at(near, np.minimum(hit + NEAR + 1, w.first[w.text[hit] + 1]), -1)
    close = by_text((best > 0) & (np.cumsum(near)[:-1] > 0))
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    chars = np.maximum(np.diff(w.begin) - 1, 1)

    def rate(mask):
        run = np.concatenate([[0], np.cumsum(mask)])
        return (run[w.begin[1:]] - run[w.begin[:-1]]) / chars

    broken = np.zeros(len(raw), bool)
    if len(raw) > 2:
        broken[1:-1] = _MARK[raw[1:-1]] & _LETTER[raw[:-2]] & _LETTER[raw[2:]]
    words_hit, stems_hit = by_text(own > 0), by_text(stem > 0)
    return np.stack([words_hit / sizes, np.log1p(words_hit), stems_hit / sizes, np.log1p(stems_hit), strongest, by_text(best) / sizes, np.log1p(close),
                     rate(_CAPITAL[raw]), rate(_LOUD[raw]), rate(_MARK[raw]), rate(broken), rate(_DIGIT[raw]), np.log1p(np.diff(w.first))], 1)


def isotonic(score: np.ndarray, weight: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of ``share`` at ascending ``score``, by pooling neighbours that are out of order."""
    pools: list[list[float]] = []
    for w, y in zip(weight, share, strict=True):
        pools.append([w, w * y, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), t / w) for w, t, k in pools]) if pools else np.zeros(0)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", trees: int = 20, depth: int = 4) -> DataFrame:
    """``doc_id`` and ``score`` of each row; ``labels`` (``doc_id``, ``toxic``) hold only rows that may be learned from."""
    rows = _toxic_rows(docs, labels, doc_id, text)
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = size.get(1, 0) / max(1, sum(size.values()))
    if not size.get(1) or not size.get(0):
        return docs.select(doc_id, F.lit(float(share)).alias("score"))
    # the third kept for calibration is in neither the lexicon nor the trees
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    lex = lexicon(rows.filter(part != 0))
    learn = stage(features(rows, lex, ["id", "toxic"]))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fit, held = vector.transform(learn.filter(part != 0)), vector.transform(learn.filter(part == 0))
    both = fit.select("toxic").distinct().count() == 2
    model = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=trees, maxDepth=depth, seed=1).fit(fit if both else vector.transform(learn))
    mark = F.floor(vector_to_array("probability")[1] * 1000)
    bins = model.transform(held).groupBy(mark.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("y")).orderBy("bin").collect()
    if bins:
        # both ends of the scale are anchored by a row each, so that no step is built on nothing
        x = np.array([0, *[r["bin"] for r in bins], 1000])
        steps = isotonic(x, np.array([1.0, *[r["n"] for r in bins], 1.0]), np.array([0.0, *[r["y"] for r in bins], 1.0]))
        table = np.interp(np.arange(1001), x, steps)
    else:
        table = np.arange(1001) / 1000
    scored = model.transform(vector.transform(features(docs, lex, [doc_id], text)))
    step = F.element_at(F.array(*[F.lit(float(v)) for v in table]), (mark + 1).cast("int"))
    return scored.select(doc_id, step.alias("score"))
