"""Language identification: multinomial naive Bayes over hashed character n-grams.

One pass sums n-gram counts by language, a second scores every text in numpy against the matrix of
log probabilities, whose size is fixed by ``buckets`` and the number of languages.

Defined cases: a text that is null or has no letter is ``und`` with score 0; texts of any length are
read whole; without a single labelled text every text is ``und``; a null ``doc_id`` is scored and
counts as not held out; ties go to the label that sorts first; further columns are kept out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.batches import small
from touchline.llm.dense import summed

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    log_prob: np.ndarray  #: buckets x labels, float32
    prior: np.ndarray


def _grams(texts: list[str], buckets: int):
    """Buckets of the 1- to 3-grams of code points and the text each belongs to."""
    joined = "\n".join(texts) + "\n"
    point = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = (point >= 65) & (point <= 90)
    point = point + upper.astype(np.uint32) * np.uint32(32)
    last = np.cumsum([len(t) + 1 for t in texts])
    mask, fold = np.uint32(buckets - 1), np.uint32(15)
    one = point * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> fold)) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> fold)) * np.uint32(0xC2B2AE35) + one[2:]
    return [((g ^ (g >> np.uint32(16))) & mask).astype(np.int64) for g in (one, two, three)], last


def _batches(texts: list[str], most: int = 1 << 18):
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def fit(docs: DataFrame, labels: tuple[str, ...], text: str = "text", lang: str = "lang", buckets: int = 1 << 14, smoothing: float = 0.5) -> LanguageModel:
    """Counts over all rows of ``docs`` with one of ``labels``; the caller has left out what is held out."""
    place = {x: i for i, x in enumerate(labels)}
    width = buckets * len(labels)

    def count(batches):
        total = np.zeros(width + 16 * len(labels), np.int64)
        for batch in batches:
            by: dict[int, list[str]] = {}
            for t, x in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if t is not None and x in place:
                    by.setdefault(place[x], []).append(t)
            for i, texts in by.items():
                total[width + i] += len(texts)
                for a, b in _batches(texts):
                    grams, last = _grams(texts[a:b], buckets)
                    for n, g in enumerate(grams):
                        # not those that reach over a text's end, so that counts do not depend on a text's neighbours
                        own = np.ones(len(g) + n, bool)
                        for back in range(n + 1):
                            own[np.maximum(last - 1 - back, 0)] = False
                        total[i * buckets:(i + 1) * buckets] += np.bincount(g[own[:len(g)]], minlength=buckets)
        return total

    total = summed(docs.select(text, lang), count, width + 16 * len(labels))
    counts = total[:width].reshape(len(labels), buckets).T + smoothing
    prior = np.log(total[width:width + len(labels)] + 1.0)
    return LanguageModel(tuple(labels), np.log(counts / counts.sum(0)).astype(np.float32), prior - np.log(np.exp(prior).sum()))


def known_labels(docs: DataFrame, lang: str = "lang") -> tuple[str, ...]:
    """The distinct labels, few by nature: a language code each."""
    return tuple(sorted(r[0] for r in docs.filter(F.col(lang).isNotNull()).select(lang).distinct().collect()))


def _has_letter(t: str | None) -> bool:
    return t is not None and (t[:1].isalpha() or any(map(str.isalpha, t)))


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score``, the posterior of the prediction."""
    names = np.array([*model.labels, UNKNOWN], dtype=object)
    table = docs.sparkSession.sparkContext.broadcast((model.log_prob, model.prior)) if model.labels else None
    buckets = len(model.log_prob)

    def score(batches):
        for batch in batches:
            texts = batch[len(keep)].to_pylist()
            best, sure = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if model_known and _has_letter(t)]
            some = [texts[i] for i in at]
            for a, b in _batches(some):
                log_prob, prior = table.value
                grams, last = _grams(some[a:b], buckets)
                begin = np.concatenate([[0], last[:-1]])
                total = np.tile(prior, (b - a, 1))
                for n, g in enumerate(grams):
                    # n-grams that reach into the next text start at its predecessor's last n places
                    ends = np.maximum(last - n - 1, begin)
                    for c in range(log_prob.shape[1]):
                        run = np.concatenate([[0.0], np.cumsum(log_prob[:, c][g], dtype=np.float64)])
                        total[:, c] += run[np.minimum(ends, len(g))] - run[np.minimum(begin, len(g))]
                top = total.max(1)
                best[at[a:b]] = total.argmax(1)
                sure[at[a:b]] = 1 / np.exp(total - top[:, None]).sum(1)
            yield pa.RecordBatch.from_arrays([*[batch[i] for i in range(len(keep))], pa.array(names[best], pa.string()), pa.array(sure)], names=[*keep, "lang_pred", "score"])

    model_known = bool(model.labels)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"
    return small(docs).select(*keep, text).mapInArrow(score, schema)


def held_out(doc_id) -> F.Column:
    """Rows whose crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
