"""Ranked lexical search by bag deduplication.

1. One pass over the texts restricts each document to the items' vocabulary and keeps its number of terms and its tf
   vector; the same pass counts documents, terms and document frequencies, summed a task at a time.
2. Rows of equal length class ``m`` and equal tf vector are one class: they meet by a hash, and the vectors themselves are
   the rest of the key, so that equal hashes never stand for equal vectors. Of a class only the ``k`` smallest ids can
   be in a list of ``k``; the window's limit drops the others before the shuffle.
3. Each class is scored once against all items of a block, a batch of classes at a time, and expanded to its members by
   ascending id. A task keeps ``k`` rows an item; a last window merges these.

Only item texts are broadcast: they are reduced to distinct texts and searched in blocks of ITEM_BYTES, each block
against all documents.

Defined cases: a null, empty or wordless text has no term, is in no list and counts for nothing; documents repeated
in the table are documents each; a null ``doc_id`` comes after all others of its score; each row of the items has a
list of its own, also where it repeats an id or a text; an item without terms or hits has no row; very long texts
are read whole; empty tables give no row; further columns are left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import words
from touchline.llm.batches import small
from touchline.session import stage

#: bytes of item texts that are held at once, on the driver and in every task
ITEM_BYTES = 4 << 20
#: scores held at once by a task
CELLS = 1 << 22
#: bytes that end a term: ASCII but letters and digits
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_DOCUMENT, _FREQUENCY, _TOTAL = range(3)


class Block:
    """Item texts of a block by term: ``hash`` of each term in order, and the items ``at[of[t]:of[t + 1]]`` that hold term t."""

    def __init__(self, keys: list[str], texts: list[str]):
        self.keys = np.array(keys, object)
        w = words.Words([t.encode("utf-8", "surrogatepass") for t in texts], words.LOWER, BREAK)
        pairs = np.unique(np.stack([w.hash, w.text.astype(np.uint64)]), axis=1)
        self.hash, begin = np.unique(pairs[0], return_index=True)
        self.at = pairs[1].astype(np.int64)
        self.of = np.append(begin, len(self.at)).astype(np.int64)


def _described(docs: DataFrame, block: Block) -> DataFrame:
    """kind, id, n, bag: a document with its number of terms and tf vector, a term with its documents, or numbers of documents and terms."""
    shared = docs.sparkSession.sparkContext.broadcast(block.hash)

    def describe(batches):
        terms = shared.value
        holding, totals = np.zeros(len(terms), np.int64), [0, 0]
        for batch in batches:
            texts = words.encoded(batch[1])
            at, size, bags = [], [], []
            for a, b in words.chunks(texts):
                w = words.Words(texts[a:b], words.LOWER, BREAK)
                n = np.diff(w.first)
                totals[0] += int((n > 0).sum())
                totals[1] += int(n.sum())
                term = np.searchsorted(terms, w.hash)
                known = np.flatnonzero(terms[np.minimum(term, len(terms) - 1)] == w.hash)
                cell, tf = np.unique(w.text[known] * len(terms) + term[known], return_counts=True)
                text, term = cell // len(terms), cell % len(terms)
                holding += np.bincount(term, minlength=len(terms))
                edge = np.searchsorted(text, np.arange(b - a + 1))
                bag = np.stack([term, tf], axis=1).astype(np.int32)
                for i in np.flatnonzero(np.diff(edge)).tolist():
                    at.append(a + i)
                    size.append(int(n[i]))
                    bags.append(bag[edge[i]:edge[i + 1]].tobytes())
            yield _rows(_DOCUMENT, batch[0].take(pa.array(at, pa.int64())), pa.array(size, pa.int64()), pa.array(bags, pa.binary()))
        some = np.flatnonzero(holding)
        yield _rows(_FREQUENCY, pa.array(some), pa.array(holding[some]), pa.nulls(len(some), pa.binary()))
        yield _rows(_TOTAL, pa.array([totals[0]]), pa.array([totals[1]]), pa.nulls(1, pa.binary()))

    return docs.mapInArrow(describe, "kind int, id long, n long, bag binary")


def _rows(kind: int, ids: pa.Array, n: pa.Array, bag: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), ids, n, bag], names=["kind", "id", "n", "bag"])


def _order() -> list[Column]:
    return [F.col("id").asc_nulls_last()]


def _classes(rows: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """m, bag, ids: each class of documents that score alike, with its ``k`` smallest ids in order."""
    # in decimals: the product passes 64 bits in a large table
    m = F.expr(f"10 + (CAST({90 * n_docs} AS DECIMAL(20, 0)) * CAST(n AS DECIMAL(18, 0))) div CAST({n_terms} AS DECIMAL(20, 0))").cast("long")
    keys = ["h", "m", "bag"]
    dealt = rows.select("id", m.alias("m"), "bag").withColumn("h", F.xxhash64("bag"))
    least = dealt.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order()))).filter(F.col("place") <= k)
    members = F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    return least.groupBy(*keys).agg(members.alias("ids")).select("m", "bag", "ids")


class _Best:
    """The ``k`` best rows of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.zeros(items, np.int64)
        self.item = self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, score, ids, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.id, ids), (self.null, null)))
        at = np.lexsort((ids, null, -score, item))
        item = item[at]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        at, last = at[place < self.k], at[place == self.k - 1]
        self.floor[item[place == self.k - 1]] = score[last]
        self.item, self.score, self.id, self.null = item[place < self.k], score[at], ids[at], null[at]


def _scored(classes: DataFrame, block: Block, weight: np.ndarray, k: int) -> DataFrame:
    """key, score, id: the ``k`` best of each task's classes, for each item."""
    shared = classes.sparkSession.sparkContext.broadcast((block, weight))

    def score(batches):
        block, weight = shared.value
        n_items = len(block.keys)
        best, step = _Best(n_items, k), max(1, CELLS // n_items)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                bags = [np.frombuffer(b, np.int32) for b in batch[1].to_pylist()]
                row = np.repeat(np.arange(len(bags)), [len(b) // 2 for b in bags])
                term, tf = np.concatenate(bags).reshape(-1, 2).T.astype(np.int64)
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * batch[0].to_numpy()[row]))
                # each occurrence of a term in an item is one addition
                often = block.of[term + 1] - block.of[term]
                upto = np.cumsum(often)
                item = block.at[np.arange(upto[-1]) + np.repeat(block.of[term] - upto + often, often)]
                total = np.zeros(len(bags) * n_items, np.int64)
                np.add.at(total, np.repeat(row, often) * n_items + item, np.repeat(part, often))
                total = total.reshape(len(bags), n_items)
                floor = np.maximum(best.floor, 1)
                if len(bags) > k:
                    floor = np.maximum(floor, np.partition(total, len(bags) - k, axis=0)[len(bags) - k])
                cls, item = np.nonzero(total >= floor)
                lists = batch[2]
                size = lists.value_lengths().to_numpy()
                ids = lists.flatten()
                begin = np.cumsum(size) - size
                many = size[cls]
                at = np.repeat(begin[cls] - np.cumsum(many) + many, many) + np.arange(many.sum())
                best.add(np.repeat(item, many), np.repeat(total[cls, item], many), ids.fill_null(0).to_numpy()[at], ids.is_null().to_numpy(zero_copy_only=False)[at])
        yield pa.RecordBatch.from_arrays([pa.array(block.keys[best.item], pa.string()), pa.array(best.score), pa.array(best.id, pa.int64(), mask=best.null)], names=["key", "score", "id"])

    return classes.mapInArrow(score, "key string, score long, id long")


def _listed(docs: DataFrame, block: Block, k: int) -> DataFrame | None:
    """key, rank, id, score of one block of items."""
    if not len(block.hash):
        return None
    rows = stage(_described(docs, block))
    n_docs, n_terms = (int(x or 0) for x in rows.filter(F.col("kind") == _TOTAL).agg(F.sum("id"), F.sum("n")).first())
    if not n_terms:
        return None
    holding = np.zeros(len(block.hash), np.int64)
    # one row a term of the block
    for term, n in rows.filter(F.col("kind") == _FREQUENCY).groupBy("id").agg(F.sum("n")).collect():
        holding[term] = n
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * holding + 1))).astype(np.int64)
    found = _scored(_classes(rows.filter(F.col("kind") == _DOCUMENT), n_docs, n_terms, k), block, weight, k)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), *_order()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("key", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` documents of highest score above 0 for each row of ``items``."""
    if not 1 <= k <= 1000:
        raise ValueError("k is 1 to 1000: a longer list would hold whole classes before the shuffle")
    key = F.sha2(F.coalesce(F.col(item_text), F.lit("")).cast("binary"), 256)
    asked = items.select(F.col(item_id), key.alias("key"), F.col(item_text).alias("text"))
    texts = stage(asked.filter("text is not null").groupBy("key").agg(F.first("text").alias("text")))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a block by hash may be a little larger than its share
    blocks = -(-size // (ITEM_BYTES // 2)) if size > ITEM_BYTES else 1
    read = small(docs).select(F.col(doc_id).cast("long").alias("id"), text)
    found = []
    for b in range(blocks):
        rows = texts.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()
        if rows:
            found.append(_listed(read, Block([r["key"] for r in rows], [r["text"] for r in rows]), k))
    found = [f for f in found if f is not None]
    none = asked.sparkSession.createDataFrame([], "key string, rank int, id long, score long")
    listed = stage(reduce(DataFrame.unionByName, found, none))
    return asked.select(item_id, "key").join(listed, "key").select(F.col(item_id), "rank", F.col("id").alias(doc_id), "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
dt AS (SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
tf AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM dt GROUP BY row, term),
lens AS (SELECT row, sum(tf) AS n FROM tf GROUP BY row),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lens),
m AS (SELECT row, 10 + ((90 * n * big_n)::BIGINT // big_l) AS m FROM lens, totals),
q AS (SELECT row_number() OVER () AS item_row, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
qt AS (SELECT item_row, any_value(item_id) AS item_id, term FROM (SELECT item_row, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM q) GROUP BY item_row, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
s AS (SELECT item_row, row, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item_row, row)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
