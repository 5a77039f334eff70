"""Substring dedup by relative Lempel-Ziv parsing against every document with a smaller id.

A reference block is a run of rows that one task has read; the index over all blocks is a shuffle by hash.

1. Every text is sampled by minimizers of 7 words, so that each window of 13 words holds one. In its
   block a minimizer of two documents is known to be shared; one row a block and minimizer is shuffled
   to find those shared between blocks.
2. Texts with shared minimizers are read again. Windows whose minimizer is shared are looked up in the
   index: sorted by hash and document in the block, then one row a block and window over all
   blocks. Each window that an earlier document has gets the place of an earlier occurrence.
3. Each text is parsed greedily: a factor starts at a window that occurs in the reference and grows
   while the next window is at the next place of the same reference; where it ends, the window at the
   boundary is looked up again. Factors are the duplicate spans; their words are removed.

A copied passage of a third of all rows costs a row a block in step 1 and 2, and a row per document
that it is removed from, dealt out by document. The hash of a window is 64 bits wide.

Defined cases: null, empty and blank texts have no words and lose none; texts shorter than a window
stay whole; rows with one id are separate and never references to each other; a null id is
never a reference and loses nothing; very long texts are parsed whole; an empty table gives no row;
further columns are kept by :func:`deduplicated` and left out of the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import words
from touchline.llm.batches import small
from touchline.session import stage

WINDOW = 13
MINIMIZER = 7
#: rows and bytes of a reference block
BLOCK_ROWS, BLOCK_BYTES = 4000, 12 << 20
#: ids of affected rows that are broadcast; more are joined by shuffle
BROADCAST_IDS = 2_000_000


def _minimizers(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Windows inside one text, and the place of the smallest 7-gram of each."""
    reach = WINDOW - MINIMIZER + 1
    if len(w.hash) < WINDOW:
        return (np.zeros(0, np.int64),) * 2
    at = np.flatnonzero(words.inside(w.text, WINDOW))
    low = np.lib.stride_tricks.sliding_window_view(words.ngrams(w.hash, MINIMIZER), reach)
    return at, at + low.argmin(1)[at]


def _blocks(batches):
    """Batches put together to blocks of about BLOCK_ROWS rows or BLOCK_BYTES."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
            block = pa.concat_batches(held)
            # nothing of a block stays here while its reader works on it
            del batch
            held, rows, size = [], 0, 0
            yield block
            del block
    if held:
        block, held = pa.concat_batches(held), []
        yield block


def _split(hashes: np.ndarray, ids: np.ndarray):
    """Order by hash and id; which rows begin a hash, and which have an earlier id in the block."""
    at = np.lexsort((ids, hashes))
    h, d = hashes[at], ids[at]
    new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    return at, first, d > d[first]


def _shared_minimizers(docs: DataFrame) -> DataFrame:
    """id, key, anchors: minimizers of a row that another document has too."""
    def local(batches):
        for block in _blocks(batches):
            some = block.filter(pc.is_valid(block[0]))
            ids, keys, texts = some[0].to_numpy(), some[1].to_numpy(), words.encoded(some[2])
            found = []
            for a, b in words.chunks(texts):
                w = words.Words(texts[a:b])
                at = np.unique(_minimizers(w)[1])
                found.append((words.ngrams(w.hash, MINIMIZER)[at].view(np.int64), w.text[at] + a))
            # the texts are not read again: only the hashes of the block are sorted
            del block, some, texts
            if not found:
                continue
            h, row = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            if not len(h):
                continue
            at = np.lexsort((row, h))
            h, row = h[at], row[at]
            once = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
            h, row = h[once], row[once]
            at, first, later = _split(h, ids[row])
            h, row = h[at], row[at]
            # the block's own: shared if a later id follows; one row of these stands for the block
            top = np.zeros(len(h), bool)
            np.logical_or.at(top, first, later)
            known = top[first]
            stands = ~known | (np.arange(len(h)) == first)
            spread = np.where(known, h ^ ids[row] * np.int64(-7046029254386353131), h)
            for s in range(0, len(h), 100_000):
                k = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(spread[k]), pa.array(h[k]), pa.array(ids[row[k]]), pa.array(keys[row[k]]), pa.array(known[k])], names=["deal", "h", "id", "key", "known"])
            stands &= known
            yield pa.RecordBatch.from_arrays([pa.array(h[stands]), pa.array(h[stands]), pa.array(ids[row[stands]]), pa.array(keys[row[stands]]), pa.array(np.zeros(stands.sum(), bool))], names=["deal", "h", "id", "key", "known"])

    def met(batches):
        parts = [[b[i].to_numpy(zero_copy_only=False) for i in range(1, 5)] for b in batches if b.num_rows]
        if not parts:
            return
        h, ids, keys, known = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.argsort(h, kind="stable")
        h, ids, keys, known = h[at], ids[at], keys[at], known[at]
        new = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(new) - 1
        # rows that stand for themselves or a block: shared if two ids meet
        low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        high = np.full(group[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, group[~known], ids[~known])
        np.maximum.at(high, group[~known], ids[~known])
        keep = np.flatnonzero(known | (low < high)[group])
        for s in range(0, len(keep), 100_000):
            k = keep[s:s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(keys[k]), pa.array(h[k])], names=["id", "key", "h"])

    rows = docs.mapInArrow(local, "deal long, h long, id long, key long, known boolean")
    shared = rows.repartition("deal").mapInArrow(met, "id long, key long, h long")
    return shared.groupBy("id", "key").agg(F.collect_list("h").alias("anchors"))


def _earlier(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """id, key, place, ref_id, ref_place: windows that start in a document with a smaller id, and one such start."""
    def local(batches):
        for batch in _blocks(batches):
            ids, keys, texts = batch[0].to_numpy(), batch[1].to_numpy(), words.encoded(batch[2])
            lists = batch[3]
            found = []
            for a, b in words.chunks(texts):
                w = words.Words(texts[a:b])
                grams = words.ngrams(w.hash, MINIMIZER)
                windows, chosen = _minimizers(w)
                if not len(windows):
                    continue
                # a minimizer that only others of this piece share is looked up in vain
                known = np.unique(lists.slice(a, b - a).flatten().to_numpy())
                at = windows[np.isin(grams[chosen].view(np.int64), known)]
                found.append((words.ngrams(w.hash, WINDOW)[at].view(np.int64), w.text[at] + a, at - w.first[w.text[at]]))
            del batch, lists, texts
            if not found:
                continue
            h, row, place = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            if not len(h):
                continue
            at, first, later = _split(h, ids[row])
            h, row, place = h[at], row[at], place[at]
            ref_id, ref_place = ids[row[first]], place[first]
            spread = np.where(later, h ^ ids[row] * np.int64(-7046029254386353131), h)
            for s in range(0, len(h), 100_000):
                k = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (spread, h, ids[row], keys[row], place, np.where(later, ref_id, -1), np.where(later, ref_place, -1), later)],
                                                 names=["deal", "h", "id", "key", "place", "ref_id", "ref_place", "later"])

    def met(batches):
        parts = [[b[i].to_numpy(zero_copy_only=False) for i in range(1, 8)] for b in batches if b.num_rows]
        if not parts:
            return
        h, ids, keys, place, ref_id, ref_place, later = (np.concatenate(x) for x in zip(*parts, strict=True))
        out = [later]
        open_ = np.flatnonzero(~later)
        at, first, late = _split(h[open_], ids[open_])
        row = open_[at]
        ref_id[row], ref_place[row] = ids[row[first]], place[row[first]]
        hit = np.zeros(len(h), bool)
        hit[row] = late
        keep = np.flatnonzero(out[0] | hit)
        for s in range(0, len(keep), 100_000):
            k = keep[s:s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (ids, keys, place, ref_id, ref_place)], names=["id", "key", "place", "ref_id", "ref_place"])

    kept = anchors.select("id", "key")
    few = kept.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    some = docs.join(F.broadcast(kept), ["id", "key"], "left_semi") if few else docs
    rows = some.join(anchors, ["id", "key"]).select("id", "key", "text", "anchors")
    rows = rows.mapInArrow(local, "deal long, h long, id long, key long, place long, ref_id long, ref_place long, later boolean")
    return rows.repartition("deal").mapInArrow(met, "id long, key long, place long, ref_id long, ref_place long")


def parse(place: np.ndarray, ref_id: np.ndarray, ref_place: np.ndarray):
    """Factors start, length, ref_id, ref_place of a text from its windows found in the reference, in order of place."""
    if not len(place):
        return (np.zeros(0, np.int64),) * 4
    goes_on = (np.diff(place) == 1) & (np.diff(ref_place) == 1) & (ref_id[1:] == ref_id[:-1])
    start = np.flatnonzero(np.append(True, ~goes_on))
    end = np.append(start[1:], len(place)) - 1
    return place[start], place[end] - place[start] + WINDOW, ref_id[start], ref_place[start]


def factors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, key, factors: the duplicate spans, in words, of each row that has one; ``key`` is xxhash64 of the text."""
    keyed = small(docs).select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    found = _earlier(keyed, stage(_shared_minimizers(keyed)))

    def parsed(batches):
        for batch in batches:
            out = []
            for row in batch[2].to_pylist():
                got = np.array(sorted({x["place"]: (x["place"], x["ref_id"], x["ref_place"]) for x in row}.values()), np.int64)
                out.append([dict(zip(("start", "length", "ref_id", "ref_place"), map(int, f), strict=True)) for f in zip(*parse(*got.T), strict=True)])
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "ref_id", "ref_place")]))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(out, kind)], names=["id", "key", "factors"])

    lists = found.groupBy("id", "key").agg(F.collect_list(F.struct("place", "ref_id", "ref_place")).alias("found"))
    return lists.mapInArrow(parsed, "id long, key long, factors array<struct<start:long,length:long,ref_id:long,ref_place:long>>")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the kept words joined by one space."""
    spans = stage(factors(docs, doc_id, text))
    names = docs.columns
    keyed = docs.withColumn("_id", F.col(doc_id).cast("long")).withColumn("_key", F.xxhash64(text))
    spans = spans.toDF("_id", "_key", "_factors")
    ids = spans.select("_id", "_key")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    # rows without a factor stay where they are read
    if few:
        hit = keyed.join(F.broadcast(ids), ["_id", "_key"], "left_semi").join(spans, ["_id", "_key"])
        rest = keyed.join(F.broadcast(ids), ["_id", "_key"], "left_anti").withColumn("_factors", F.lit(None).cast(spans.schema["_factors"].dataType))
        both = hit.select(*names, "_factors").unionByName(rest.select(*names, "_factors"))
    else:
        both = keyed.join(spans, ["_id", "_key"], "left").select(*names, "_factors")
    at = names.index(text)

    def kept(batches):
        for batch in batches:
            texts = words.encoded(batch[at])
            spans_ = batch[len(names)].to_pylist()
            n_words, n_removed, out = [], [], []
            for t, row in zip(texts, spans_, strict=True):
                ws = t.split()
                if row:
                    keep = np.ones(len(ws), bool)
                    for f in row:
                        keep[f["start"]:f["start"] + f["length"]] = False
                    n_removed.append(int(len(ws) - keep.sum()))
                    out.append(b" ".join([w for w, k in zip(ws, keep.tolist(), strict=True) if k]))
                else:
                    n_removed.append(0)
                    out.append(b" ".join(ws))
                n_words.append(len(ws))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_words long, n_removed long, kept string"
    return both.mapInArrow(kept, schema)


