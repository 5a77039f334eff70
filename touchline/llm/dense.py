"""Sums of vectors of fixed length over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.batches import small

#: a vector travels in so many pieces, each summed by a task of its own
PIECES = 16


def summed(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int) -> np.ndarray:
    """``count`` maps the batches of a partition to ``length`` integers; the sum over partitions.

    The vector's length is a parameter of the operator, so what reaches the driver does not grow
    with the data; ``length`` is a multiple of PIECES. A table without rows gives zeros.
    """
    step = length // PIECES

    def partial(batches):
        total = count(batches)
        if total.any():
            rows = [np.ascontiguousarray(total[i * step:(i + 1) * step], dtype=np.int64) for i in range(PIECES)]
            kept = [i for i in range(PIECES) if rows[i].any()]
            yield pa.RecordBatch.from_pydict({"piece": pa.array(kept, pa.int32()), "total": pa.array([_packed(rows[i]) for i in kept], pa.binary())})

    def merged(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, row in zip(batch["piece"].to_pylist(), batch["total"].to_pylist(), strict=True):
                totals[piece] = totals.get(piece, 0) + _unpacked(row, step)
        if totals:
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(totals), pa.int32()), "total": pa.array([_packed(v) for v in totals.values()], pa.binary())})

    schema = "piece int, total binary"
    rows = small(df).mapInArrow(partial, schema).repartition(PIECES, F.col("piece")).mapInArrow(merged, schema).collect()
    out = np.zeros(length, np.int64)
    for r in rows:
        out[r["piece"] * step:(r["piece"] + 1) * step] += _unpacked(r["total"], step)
    return out


def _packed(v: np.ndarray) -> bytes:
    """Place and value of what is not zero, if that is shorter."""
    at = np.flatnonzero(v)
    if 12 * len(at) < 8 * len(v):
        return b"s" + at.astype(np.int32).tobytes() + v[at].tobytes()
    small = v.max(initial=0) < 2**31
    return (b"i" + v.astype(np.int32).tobytes()) if small else (b"l" + v.tobytes())


def _unpacked(row: bytes, length: int) -> np.ndarray:
    kind, body = row[:1], row[1:]
    if kind == b"s":
        n = len(body) // 12
        out = np.zeros(length, np.int64)
        out[np.frombuffer(body[:4 * n], np.int32)] = np.frombuffer(body[4 * n:], np.int64)
        return out
    return np.frombuffer(body, np.int32 if kind == b"i" else np.int64).astype(np.int64)
