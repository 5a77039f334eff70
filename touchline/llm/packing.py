"""Packing of documents into sequences of fixed length by the sum-of-squares rule.

Each document is tokenized where it is read and cut into full windows and a rest. A full window is a
sequence of its own; a rest goes to the fill level that makes the sum of squared counts of partly
filled sequences smallest, tracked in one array of counts by level. Only lengths and digests are
shuffled. Each partition packs its own rests, so at most ``length - 1`` sequences a partition
stay partly filled, however many documents there are.

Defined cases: null and empty texts hold the end id alone; very long texts are cut into as many
windows as they need; repeated rows are packed each; a null ``doc_id`` is kept; an empty table gives
no piece; further columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.batches import small
from touchline.llm.tokens import encoder

LENGTH = 1024
END_ID = 0


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    def cut(batches):
        encode = encoder(path).encode
        for batch in batches:
            row, start, size, digest, total = [], [], [], [], []
            for i, ids in enumerate(encode([t or "" for t in batch[1].to_pylist()])):
                data = ids.astype("<u4").tobytes() + END_ID.to_bytes(4, "little")
                n = len(data) // 4
                for at in range(0, n, length):
                    part = data[4 * at:4 * (at + length)]
                    row.append(i)
                    start.append(at)
                    size.append(len(part) // 4)
                    digest.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, digest, total))], names=[doc_id, "start", "length", "ids_crc32", "doc_tokens"])

    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return small(docs).select(doc_id, text).mapInArrow(cut, schema)


class Levels:
    """Open sequences by fill level, and the rule that picks one."""

    def __init__(self, length: int):
        self.length = length
        self.count = np.zeros(length + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def level(self, size: int) -> int:
        """Level to fill up; 0 opens a sequence. Moving one from h to h + size changes the sum of squares by 2 (count[h + size] - count[h] + 1)."""
        if size >= self.length:
            return 0
        here = self.count[:self.length - size + 1]
        change = 2 * (self.count[size:] - here + 1)
        change[-1] -= 1  # a full sequence is counted no more, so only its old level changes
        change[here == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.count[size] + 1
        # of equal changes the fullest
        return int(len(change) - 1 - np.argmin(change[::-1]))


def pack(parts: DataFrame, doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``."""
    def place(batches):
        levels, new = Levels(length), TaskContext.get().partitionId() << 40
        for batch in batches:
            sequence, offset = [], []
            for size in batch["length"].to_pylist():
                h = levels.level(size)
                if h:
                    at = levels.open[h].pop()
                    levels.count[h] -= 1
                else:
                    at, new = new, new + 1
                if h + size < length:
                    levels.open[h + size].append(at)
                    levels.count[h + size] += 1
                sequence.append(at)
                offset.append(h)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    dealt = parts.repartition(F.col(doc_id), F.col("start"))
    return dealt.sortWithinPartitions(doc_id, "start", "ids_crc32").mapInArrow(place, schema)
