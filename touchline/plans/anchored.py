"""Anchored grouping: a row joins the open group while it lies within ``gap`` of the group's FIRST row.

Measured from the first row, membership depends on everything before it, so no window function
expresses it and a fold over a whole key would need the key in one task. Instead each time block is
reduced to a small step function from the open anchor on entry to the open anchor on exit. Only rows
in the first ``gap`` seconds of a block can be absorbed by an older anchor, and neighbouring starts
soon agree, so the function has few steps. Step functions compose, so they are combined in groups of
``fanout`` blocks, the combined ones per key, and the entry anchors are handed back down. Every task
holds one block, or ``fanout`` step functions.

A group also closes where ``tag`` changes (another team's row in between).
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.plans.segments import segment_of
from touchline.session import stage

NONE = -1.0e300  # "no open group": older than everything


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time, tie and tag of a block's rows in order."""
    t, tie, tag = (table[c].to_numpy() for c in ("_t", "_tie", "_tag"))
    order = np.lexsort((tie, t))
    return t[order], tie[order], tag[order]


def _successors(t: np.ndarray, tag: np.ndarray, gap: float) -> np.ndarray:
    """For every row the start of the group after the one anchored there (len(t) if none)."""
    n = len(t)
    stops = np.append(np.flatnonzero(tag[1:] != tag[:-1]) + 1, n)
    ends = stops[np.searchsorted(stops, np.arange(n), side="right")]
    return _absorbed(t, t, np.arange(1, n + 1), ends, gap)


def _absorbed(t: np.ndarray, t0: np.ndarray, lo: np.ndarray, hi: np.ndarray, gap: float) -> np.ndarray:
    """First row in [lo, hi) more than ``gap`` after ``t0``; hi if there is none."""
    j = np.clip(np.searchsorted(t, t0 + gap, side="right"), lo, hi)
    # the difference decides, of which the sum may be one rounding off
    while (more := (j < hi) & (t[np.minimum(j, len(t) - 1)] - t0 <= gap)).any():
        j = j + more
    while (less := (j > lo) & (t[j - 1] - t0 > gap)).any():
        j = j - less
    return j


def _first_start(t: np.ndarray, tag: np.ndarray, t0: float, tag0: str, gap: float) -> int:
    """First row that the anchor (t0, tag0) from before the block does not absorb."""
    others = np.flatnonzero(tag != tag0)
    hi = int(others[0]) if len(others) else len(t)
    return int(_absorbed(t, np.array([t0]), np.array([0]), np.array([hi]), gap)[0])


def _constants(table: pa.Table) -> dict[str, pa.Array]:
    """The key columns of a group and its block, one row."""
    return {c: table[c].slice(0, 1).combine_chunks() for c in table.column_names if c.startswith("_k_") or c == "_blk"}


def _summarise(gap: float):
    def block(table: pa.Table) -> pa.Table:
        t, _, tag = _sorted(table)
        n = len(t)
        # candidates: rows an older anchor may leave as first start, then the first row it cannot absorb
        following = _successors(t, tag, gap).tolist()
        count = min(following[0] + 1, n)
        final = {}

        def settle(i: int) -> int:
            path = []
            while i not in final:
                path.append(i)
                if following[i] >= n:
                    final[i] = i
                    break
                i = following[i]
            out = final[i]
            for p in path:
                final[p] = out
            return out

        outs = [settle(i) for i in range(count)]
        steps = [i for i in range(count) if i + 1 == count or outs[i + 1] != outs[i]]
        times, tags = pa.list_(pa.float64()), pa.list_(pa.string())
        return pa.table({
            **_constants(table),
            "first_tag": pa.array([tag[0]], pa.string()),
            "cand_t": pa.array([[float(t[i]) for i in steps]], times),
            "cand_tag": pa.array([[str(tag[i]) for i in steps]], tags),
            "out_t": pa.array([[float(t[outs[i]]) for i in steps]], times),
            "out_tag": pa.array([[str(tag[outs[i]]) for i in steps]], tags),
        })

    return block


def _enter(row, t0: float, tag0: str, gap: float) -> tuple[float, str]:
    """Exit anchor of a summarised block entered with anchor (t0, tag0)."""
    cand = row.cand_t
    if row.first_tag != tag0:
        return row.out_t[0], row.out_tag[0]
    for i in range(len(cand)):
        if row.cand_tag[i] != tag0 or cand[i] - t0 > gap:
            return row.out_t[i], row.out_tag[i]
    return t0, tag0


def _compose(gap: float, level: str):
    """Summaries of consecutive blocks into one summary of their union."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("_blk").itertuples(index=False, name="Row"))
        rows = [_named(r) for r in rows]
        first = rows[0]
        cand = list(zip(first.cand_t, first.cand_tag, first.out_t, first.out_tag))
        rest = rows[1:]
        if rest:  # an anchor that outlives the first block meets the second, which it cannot absorb whole
            second = rest[0]
            cand += list(zip(second.cand_t, second.cand_tag, second.out_t, second.out_tag))
        done = []
        for i, (ct, ctag, ot, otag) in enumerate(cand):
            later = rest if i < len(first.cand_t) else rest[1:]
            for r in later:
                ot, otag = _enter(r, ot, otag, gap)
            done.append((ct, ctag, ot, otag))
        keep = [
            c for i, c in enumerate(done)
            if i + 1 == len(done) or done[i + 1][2:] != c[2:] or done[i + 1][1] != c[1]
        ]
        head = pdf.iloc[0]
        return pd.DataFrame({
            **{c: [head[c]] for c in pdf.columns if c.startswith("_k_")},
            "_blk": [head[level]],
            "first_tag": [first.first_tag],
            "cand_t": [[c[0] for c in keep]],
            "cand_tag": [[c[1] for c in keep]],
            "out_t": [[c[2] for c in keep]],
            "out_tag": [[c[3] for c in keep]],
        })

    return group


class _Row:
    __slots__ = ("first_tag", "cand_t", "cand_tag", "out_t", "out_tag")


def _named(r) -> _Row:
    out = _Row()
    out.first_tag = r.first_tag
    for f in ("cand_t", "cand_tag", "out_t", "out_tag"):
        setattr(out, f, list(getattr(r, f)))
    return out


def _hand_down(gap: float):
    """Entry anchors of consecutive blocks, given the entry anchor of the first."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        t0, tag0 = float(pdf["_in_t"].iloc[0]), str(pdf["_in_tag"].iloc[0])
        ins = []
        for r in pdf.itertuples(index=False, name="Row"):
            ins.append((t0, tag0))
            t0, tag0 = _enter(_named(r), t0, tag0, gap)
        keys = [c for c in pdf.columns if c.startswith("_k_") or c == "_blk"]
        return pdf[keys].assign(_in_t=[i[0] for i in ins], _in_tag=[i[1] for i in ins])

    return group


def _label(gap: float):
    def block(table: pa.Table) -> pa.Table:
        t, tie, tag = _sorted(table)
        n, following = len(t), _successors(t, tag, gap).tolist()
        t0, tag0 = table["_in_t"][0].as_py(), table["_in_tag"][0].as_py()
        first = i = _first_start(t, tag, t0, tag0, gap)
        starts = []
        while i < n:
            starts.append(i)
            i = following[i]
        opens = np.zeros(n, dtype=bool)
        opens[starts] = True
        anchor = np.repeat(np.append(t0, t[starts]), np.diff([0, first, *starts[1:], n] if starts else [0, n]))
        keys = {c: table[c] for c in table.column_names if c.startswith("_k_")}
        return pa.table({**keys, "_t": t, "_tie": tie, "_anchor": anchor, "_opens": opens})

    return block


def anchored_groups(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: str,
    gap: float,
    tag: str | None = None,
    block_s: float | None = None,
    fanout: int = 1024,
) -> DataFrame:
    """Adds ``anchor_s`` (time of the group's first row) and ``opens_group``.

    ``(keys, time, tie)`` identifies a row. Read ``df`` from a stage table if it is costly: it is
    read for the summaries, for the labels and for the final join. Blocks are dealt into
    ``spark.sql.shuffle.partitions`` tasks that are not merged, since their few bytes are much work.
    """
    width = block_s or max(20.0 * gap, 600.0)
    if width <= gap:
        raise ValueError("blocks must be longer than the gap")
    types = dict(df.dtypes)
    kcols = [f"_k_{i}" for i in range(len(keys))]
    kschema = ", ".join(f"{k} {types[c]}" for k, c in zip(kcols, keys))
    slim = df.select(
        *[F.col(c).alias(k) for k, c in zip(kcols, keys)],
        segment_of(F.col(time), width).alias("_blk"),
        F.col(time).cast("double").alias("_t"),
        F.col(tie).cast("bigint").alias("_tie"),
        (F.col(tag).cast("string") if tag else F.lit("")).alias("_tag"),
    ).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *kcols, "_blk")
    step = (
        f"{kschema}, _blk bigint, first_tag string, cand_t array<double>, cand_tag array<string>, "
        "out_t array<double>, out_tag array<string>"
    )
    blocks = slim.groupBy(*kcols, "_blk").applyInArrow(_summarise(gap), step)
    upper = F.floor(F.col("_blk") / F.lit(fanout)).cast("bigint")
    # read on the way up and on the way down
    blocks = stage(blocks.withColumn("_sup", upper))
    supers = blocks.groupBy(*kcols, "_sup").applyInPandas(_compose(gap, "_sup"), step)

    entry = f"{kschema}, _blk bigint, _in_t double, _in_tag string"
    start = supers.withColumn("_in_t", F.lit(NONE)).withColumn("_in_tag", F.lit("\u0000"))
    sup_in = start.groupBy(*kcols).applyInPandas(_hand_down(gap), entry).withColumnRenamed("_blk", "_sup")
    blk_in = (
        blocks.join(sup_in, [*kcols, "_sup"])
        .groupBy(*kcols, "_sup").applyInPandas(_hand_down(gap), entry)
    )
    labelled = (
        slim.join(blk_in, [*kcols, "_blk"])
        .groupBy(*kcols, "_blk")
        .applyInArrow(_label(gap), f"{kschema}, _t double, _tie bigint, _anchor double, _opens boolean")
    )
    named = labelled.select(
        *[F.col(k).alias(c) for k, c in zip(kcols, keys)],
        F.col("_t").alias(time), F.col("_tie").cast(types[tie]).alias(tie),
        F.col("_anchor").alias("anchor_s"), F.col("_opens").alias("opens_group"),
    )
    return df.join(named, [*keys, time, tie])
