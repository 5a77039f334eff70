"""N-gram Jaccard join as a grouped prefix join.

1. Shingles are hashed to 64 bits where the text is read. A table of counts of fixed size over all
   shingles puts frequent ones last in one order for all documents.
2. Documents of equal sets become one class. A class keeps the first ``floor(n/5) + 1`` of its ``n``
   shingles in that order: two sets of Jaccard similarity 0.8 share one of these.
3. Classes of identical prefix and size are one group; only groups meet by shingle, and only shingles
   of two groups are kept.
4. Group pairs are filtered by size, by the smaller one's shorter prefix, and by a lower bound of the
   difference from parity bitmaps; what is left is expanded to members and verified on whole sets.

For components not every pair is wanted: in a few rounds each group meets the smallest group of another
component in one of its shingles' lists, then, for lists that still hold several components, every
pair of different components is verified. So a large group of near copies costs a star, and no pair that could
join two components is left out.

Defined cases: null, empty and blank texts have an empty set and link with nothing; fewer words than
a shingle are one shingle; equal texts are linked; rows that repeat an id are one node with the links of all its texts;
rows with a null id have a null component and link nothing; further columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import words
from touchline.llm.batches import small
from touchline.llm.components import components
from touchline.llm.dense import summed
from touchline.session import stage

#: counters of the frequency order; its size on the driver and executors, whatever the data's
COUNTERS = 1 << 18
#: bits of the parity bitmap that lists are compared by; the one that pairs are compared by has two bits a shingle at least
BITS = 1024
#: ids of candidates that are broadcast; more are joined by shuffle
BROADCAST_IDS = 2_000_000


def shingle_sets(texts: list[bytes], n: int, fold: np.ndarray = words.LOWER):
    """Sorted distinct shingle hashes of each text."""
    for a, b in words.chunks(texts):
        w = words.Words(texts[a:b], fold)
        grams = words.ngrams(w.hash, n)
        for i in range(b - a):
            s, e = w.first[i], w.first[i + 1]
            if e - s >= n:
                yield np.unique(grams[s:e - n + 1])
            else:
                yield words.ngrams(w.hash[s:e], e - s) if e > s else np.zeros(0, np.uint64)


def order(docs: DataFrame, text: str, n: int, counters: int = COUNTERS) -> np.ndarray:
    """Two to the power of it bounds how often a shingle of a counter occurs in all documents."""
    def count(batches):
        total = np.zeros(counters, np.int64)
        for batch in batches:
            for s in _grouped(shingle_sets(words.encoded(batch[0]), n)):
                total += np.bincount((s & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
        return total

    return np.ceil(np.log2(summed(docs.select(text), count, counters) + 1)).astype(np.uint8)


def _grouped(sets, most: int = 1 << 18):
    held, size = [], 0
    for s in sets:
        held.append(s)
        size += len(s)
        if size > most:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _described(docs: DataFrame, doc_id: str, text: str, n: int, rank: np.ndarray) -> DataFrame:
    """id, size, cls, pkey, prefix (in order), bits, wide of each row; an empty set has a null class, a short one no wide bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def describe(batches):
        for batch in batches:
            low = shared.value
            size, cls, pkey, prefix, bits, wide = [], [], [], [], [], []
            for s in shingle_sets(words.encoded(batch[1]), n):
                size.append(len(s))
                rare = np.argsort(low[(s & np.uint64(len(low) - 1)).astype(np.int64)], kind="stable")[:len(s) // 5 + 1]
                first = s[rare].tobytes()
                cls.append(_mark(s.tobytes()) if len(s) else None)
                pkey.append(_mark(first) if len(s) else None)
                prefix.append(first if len(s) else None)
                bits.append(_parity(s, BITS) if len(s) else None)
                wide.append(_parity(s, 1 << (2 * len(s) - 1).bit_length()) if 2 * len(s) > BITS else None)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(pkey, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary())],
                                             names=["id", "size", "cls", "pkey", "prefix", "bits", "wide"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), text).mapInArrow(describe, "id long, size long, cls long, pkey long, prefix binary, bits binary, wide binary")


def _parity(s: np.ndarray, bits: int) -> bytes:
    """Whether an odd number of shingles has each of the ``bits`` values of the leading hash bits."""
    odd = np.bincount((s >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of two sets only; the longer bitmap is folded to the length of the other."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.packbits(np.bitwise_xor.reduce(np.unpackbits(y).reshape(len(x) * 8, -1), axis=1))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _mark(data: bytes) -> int:
    """64 bits that stand for a set or a prefix."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _small(ids: DataFrame) -> DataFrame:
    """Broadcast behind a check of the size, else shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _shared_tokens(groups: DataFrame) -> DataFrame:
    """token, gid, size, first: prefix shingles of at least two groups. ``first`` marks the shorter prefix."""
    def spread(batches):
        for batch in batches:
            gid, size = batch[0].to_numpy(), batch[1].to_numpy()
            prefix = [np.frombuffer(p, np.int64) for p in batch[2].to_pylist()]
            lengths = np.array([len(p) for p in prefix])
            place = np.concatenate([np.arange(k) for k in lengths]) if len(lengths) else np.zeros(0, np.int64)
            # a partner of the same size or more shares ceil(8n/9) shingles, so one of the first n - ceil(8n/9) + 1
            short = size - -(-8 * size // 9) + 1
            first = place < np.repeat(short, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefix) if len(prefix) else place), pa.array(np.repeat(gid, lengths)), pa.array(np.repeat(size * 2, lengths) + first)], names=["token", "gid", "size2"])

    def meet(batches):
        parts = [(b[0].to_numpy(), b[1].to_numpy(), b[2].to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        token, gid, size2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.argsort(token, kind="stable")
        token, gid, size2 = token[at], gid[at], size2[at]
        same = token[1:] == token[:-1]
        some = np.flatnonzero(np.append(same, False) | np.append(False, same))
        for i in range(0, len(some), 50_000):
            k = some[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(token[k]), pa.array(gid[k]), pa.array(size2[k] >> 1), pa.array((size2[k] & 1).astype(bool))], names=["token", "gid", "size", "first"])

    rows = groups.select("gid", "size", "prefix").mapInArrow(spread, "token long, gid long, size2 long")
    return rows.repartition("token").mapInArrow(meet, "token long, gid long, size long, first boolean")


def _near(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs of classes whose bitmaps leave 100 * intersection >= 80 * union possible."""
    whole = bits.select("rep", F.coalesce("wide", "bits"), "size")
    both = pairs.join(whole.toDF("a", "bits_a", "size_a"), "a").join(whole.toDF("b", "bits_b", "size_b"), "b")

    def keep(batches):
        for batch in batches:
            apart = [_apart(x, y) for x, y in zip(batch[2].to_pylist(), batch[3].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1]], names=["a", "b"]).filter(pa.array(9 * np.array(apart, np.int64) <= batch[4].to_numpy() + batch[5].to_numpy(), pa.bool_()))

    return both.select("a", "b", "bits_a", "bits_b", "size_a", "size_b").mapInArrow(keep, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """Those of ``pairs`` (a staged table) whose whole sets link."""
    ids = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    wanted = docs.select(F.col(doc_id).cast("long").alias("id"), text).join(_small(ids), "id", "left_semi")

    def whole(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[0], pa.array([s.tobytes() for s in shingle_sets(words.encoded(batch[1]), n)], pa.binary())], names=["id", "shingles"])

    sets = wanted.mapInArrow(whole, "id long, shingles binary")

    def link(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch[2].to_pylist(), batch[3].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                hit.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1]], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    met = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return met.select("a", "b", "set_a", "set_b").mapInArrow(link, "a long, b long").distinct()


def _leaders(lists: DataFrame, known: DataFrame | None, tested: DataFrame | None) -> DataFrame:
    """At most one pair a group: with the smallest group of another component that leads one of its lists and wasn't tested."""
    if known is not None:
        lists = lists.join(known, lists["gid"] == known["node"], "left").drop("node").withColumn("component", F.coalesce("component", "gid"))
    else:
        lists = lists.withColumn("component", F.col("gid"))
    head = F.min(F.struct("gid", "size", "first", "component"))
    one = lists.groupBy("token").agg(head.alias("one"))
    met = lists.join(one, "token")
    two = met.filter("component <> one.component").groupBy("token").agg(head.alias("two"))
    met = met.join(two, "token").withColumn("lead", F.when(F.col("component") == F.col("one.component"), F.col("two")).otherwise(F.col("one")))
    fits = F.when(F.col("size") <= F.col("lead.size"), F.col("first") & (5 * F.col("size") >= 4 * F.col("lead.size"))).otherwise(F.col("lead.first") & (5 * F.col("lead.size") >= 4 * F.col("size")))
    pairs = met.filter(fits).select("gid", F.col("lead.gid").alias("other"), F.least("gid", "lead.gid").alias("a"), F.greatest("gid", "lead.gid").alias("b"))
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    return pairs.groupBy("gid").agg(F.min("other").alias("other")).select(F.least("gid", "other").alias("a"), F.greatest("gid", "other").alias("b")).distinct()


def _across(tokens: DataFrame, members: DataFrame, bits: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of classes of different components in the lists that hold several, filtered by size and bitmap."""
    comp = stage(members.join(known, members["rep"] == known["node"], "left").select("gid", "rep", F.coalesce("component", "rep").alias("component")))
    of_group = comp.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    lists = tokens.join(of_group, "gid")
    mixed = lists.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("token")
    at = tokens.join(mixed, "token", "left_semi").join(comp, "gid").join(bits.select("rep", "bits"), "rep")

    def cross(batches):
        for key, comp_, rep, size, first, bits in _lists(batches):
            at = np.argsort(size, kind="stable")
            comp_, rep, size, first, bits = comp_[at], rep[at], size[at], first[at], bits[at]
            if comp_.min() == comp_.max():
                continue
            for j in range(1, len(rep)):
                lo = np.searchsorted(size, -(-4 * size[j] // 5))
                k = np.arange(lo, j)
                k = k[(comp_[lo:j] != comp_[j]) & first[lo:j]] if len(k) else k
                if len(k):
                    apart = np.bitwise_count(bits[k] ^ bits[j]).sum(1, dtype=np.int64)
                    k = k[9 * apart <= size[k] + size[j]]
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[k], rep[j])), pa.array(np.maximum(rep[k], rep[j]))], names=["a", "b"])

    rows = at.select("token", "component", "rep", "size", "first", "bits").repartition("token").sortWithinPartitions("token", "rep")
    return rows.mapInArrow(cross, "a long, b long").distinct()


def _lists(batches):
    """Rows of one key after another from sorted batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch[0].to_numpy(), batch[1].to_numpy(), batch[2].to_numpy(), batch[3].to_numpy(), batch[4].to_numpy(zero_copy_only=False),
               np.frombuffer(b"".join(batch[5].to_pylist()), np.uint8).reshape(-1, BITS // 8)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        edge = np.flatnonzero(np.diff(held[0])) + 1
        for s, e in zip([0, *edge[:-1]], edge, strict=False):
            yield (held[0][s], *(x[s:e] for x in held[1:]))
        if len(edge):
            held = [x[edge[-1]:] for x in held]
    if held is not None:
        yield (held[0][0], *held[1:])


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, rounds: int = 3) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row: the smallest id reachable by links of Jaccard similarity 0.8."""
    described = stage(_described(small(docs), doc_id, text, n, order(docs, text, n)))
    # a class is known by the smallest id of its rows
    reps = described.filter("cls is not null and id is not null").groupBy("cls", "size", "pkey").agg(F.min("id").alias("rep"))
    low = reps.groupBy("size", "pkey").agg(F.min("rep").alias("gid"))
    members = stage(reps.join(low, ["size", "pkey"]).select("gid", "cls", "rep", "size"))
    own = described.select("id", "cls", "size", "prefix", "bits", "wide").join(_small(members.select("cls", F.col("rep").alias("id"), "gid")), ["cls", "id"])
    bits = own.select(F.col("id").alias("rep"), "bits", "wide", "size")
    tokens = stage(_shared_tokens(own.filter("gid = id")))

    inner = members.filter("gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    tested, known = None, None
    for _ in range(rounds):
        pairs = _leaders(tokens, known, tested)
        pairs = stage(pairs if tested is not None else pairs.union(inner).distinct())
        if tested is not None and pairs.isEmpty():
            break
        new = stage(_verified(stage(_near(pairs, bits)), docs, doc_id, text, n))
        tested = pairs if tested is None else tested.union(pairs)
        if known is None or not new.isEmpty():
            known = stage(components(new, known))
    # groups of several members are lists as well
    several = members.groupBy("gid", "size").count().filter("count > 1")
    lists = tokens.unionByName(several.select(F.xxhash64(F.lit("group"), "gid").alias("token"), "gid", "size", F.lit(True).alias("first")))
    rest = stage(_near(_across(lists, members, bits, known).join(tested, ["a", "b"], "left_anti"), bits))
    if not rest.isEmpty():
        known = stage(components(_verified(rest, docs, doc_id, text, n), known))

    # an id with several texts is one node: it links their classes
    twice = described.filter("cls is not null and id is not null").groupBy("id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("id")
    if not twice.isEmpty():
        own = described.filter("cls is not null").join(twice, "id").select("id", "cls").distinct().join(members.select("cls", "rep"), "cls")
        links = own.join(own.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b"))
        known = stage(components(links, known))
    of_class = members.join(known, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    out = described.select("id", "size", "cls").join(of_class, "cls", "left")
    return out.select(F.col("id").alias(doc_id), F.col("size").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
