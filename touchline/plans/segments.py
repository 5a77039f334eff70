"""Sequence scans that never put a whole key into one task.

A window over ``partitionBy(match)`` sends every row of a match to one task. Here a sequence is cut
into segments (a pure function of an order column), windows run per ``(key, segment)``, and what
must cross a segment border travels in one of two ways:

* *carry*: one summary row per segment, scanned over the (few) segments of a key and joined back
  on ``(key, segment)``; for lag, last-known-value, running counts and row numbers;
* *halo*: the rows near the end of a segment are copied into the next one; for bounded frames.

Both are exact. Border work is one summary row per segment, or a bounded number of copied rows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: frames (or row numbers) per segment; about 11 minutes at 25 Hz
SEGMENT_ROWS = 16384
#: seconds per segment for sequences ordered by match time
SEGMENT_S = 900.0

SEG = "_seg"


def segment_of(order: Column, width: float) -> Column:
    return F.floor(order / F.lit(width)).cast("bigint")


def _within(keys: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*keys, SEG).orderBy(*order)


def _earlier(keys: Sequence[str]) -> Window:
    """Every earlier segment of the same key, on the summary table."""
    return Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(carry, [*keys, SEG], "left")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[str],
    order: Sequence,
    name: str = "row_no",
    total: str | None = None,
) -> DataFrame:
    """Dense 1-based row number per key, in the order of ``buckets`` then ``order``.

    ``buckets`` are order-preserving columns from coarse to fine. Row counts per bucket are scanned
    level by level, so the widest window holds the buckets of one level, never the rows of a key.
    """
    keys, buckets = list(keys), list(buckets)
    counts = df.groupBy(*keys, *buckets).agg(F.count(F.lit(1)).alias("_n"))
    table, offset = None, F.lit(0).cast("bigint")
    for depth in range(len(buckets)):
        fine = depth + 1 == len(buckets)
        level = counts if fine else counts.groupBy(*keys, *buckets[: depth + 1]).agg(F.sum("_n").alias("_n"))
        parent = Window.partitionBy(*keys, *buckets[:depth])
        earlier = parent.orderBy(buckets[depth]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn(f"_before_{depth}", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        if total and depth == 0:
            level = level.withColumn(total, F.sum("_n").over(parent))
        offset = offset + F.col(f"_before_{depth}")
        level = level.drop("_n")
        table = level if table is None else level.join(table, keys + buckets[:depth])
    table = table.select(*keys, *buckets, offset.alias("_offset"), *([total] if total else []))
    rn = F.row_number().over(Window.partitionBy(*keys, *buckets).orderBy(*order))
    out = df.join(table, keys + buckets).withColumn(name, rn + F.col("_offset"))
    return out.drop("_offset")


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence, columns: dict[str, str]
) -> DataFrame:
    """Value of the preceding row of the key. ``df`` carries ``_seg``; columns maps output to input."""
    values = F.struct(*[F.col(c).alias(o) for o, c in columns.items()])
    ends = df.groupBy(*keys, SEG).agg(F.max_by(values, F.struct(*order)).alias("_end"))
    carry = ends.select(*keys, SEG, F.lag("_end").over(Window.partitionBy(*keys).orderBy(SEG)).alias("_carry"))
    w = _within(keys, order)
    lagged = _attach(df, carry, keys).withColumn("_lag", F.coalesce(F.lag(values).over(w), F.col("_carry")))
    return lagged.select(df["*"], *[F.col("_lag")[o].alias(o) for o in columns])


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence, columns: dict[str, Column]
) -> DataFrame:
    """Last non-null value up to and including the row."""
    place = F.struct(*order)
    ends = df.groupBy(*keys, SEG).agg(*[
        F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_c_{o}") for o, c in columns.items()
    ])
    carry = ends.select(*keys, SEG, *[
        F.last(f"_c_{o}", ignorenulls=True).over(_earlier(keys)).alias(f"_c_{o}") for o in columns
    ])
    w = _within(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _attach(df, carry, keys).select(df["*"], *[
        F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_c_{o}")).alias(o)
        for o, c in columns.items()
    ])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence, columns: dict[str, Column]
) -> DataFrame:
    """Running total up to and including the row."""
    sums = df.groupBy(*keys, SEG).agg(*[F.sum(c).alias(f"_c_{o}") for o, c in columns.items()])
    carry = sums.select(*keys, SEG, *[F.sum(f"_c_{o}").over(_earlier(keys)).alias(f"_c_{o}") for o in columns])
    w = _within(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0)
    return _attach(df, carry, keys).select(df["*"], *[
        (F.coalesce(F.sum(c).over(w), zero) + F.coalesce(F.col(f"_c_{o}"), zero)).alias(o)
        for o, c in columns.items()
    ])


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence, columns: dict[str, Column]
) -> DataFrame:
    """Running maximum over the rows before this one."""
    tops = df.groupBy(*keys, SEG).agg(*[F.max(c).alias(f"_c_{o}") for o, c in columns.items()])
    carry = tops.select(*keys, SEG, *[F.max(f"_c_{o}").over(_earlier(keys)).alias(f"_c_{o}") for o in columns])
    w = _within(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return _attach(df, carry, keys).select(df["*"], *[
        F.greatest(F.max(c).over(w), F.col(f"_c_{o}")).alias(o) for o, c in columns.items()
    ])


def count_since(
    df: DataFrame, keys: Sequence[str], order: Sequence, reset: Column, name: str, count_reset: bool = True
) -> DataFrame:
    """Rows since the last reset row; all rows so far if there was none.

    The reset row itself counts one, or nothing with ``count_reset=False``.
    """
    own = 1 if count_reset else 0
    w = _within(keys, order)
    local = df.withColumn("_reset", reset).withColumn("_i", F.row_number().over(w))
    ends = local.groupBy(*keys, SEG).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_reset"), F.col("_i"))).alias("_at")
    )
    so_far = ends.withColumn("_before", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)))
    marks = so_far.withColumn("_mark", F.col("_before") + F.col("_at") - own)
    carry = marks.select(
        *keys, SEG,
        (F.col("_before") - F.coalesce(F.last("_mark", ignorenulls=True).over(_earlier(keys)), F.lit(0))).alias("_carry"),
    )
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.last(F.when(F.col("_reset"), F.col("_i")), ignorenulls=True).over(running)
    count = F.when(at.isNotNull(), F.col("_i") - at + own).otherwise(F.col("_i") + F.col("_carry"))
    return _attach(local, carry, keys).select(df["*"], count.cast("bigint").alias(name))


def with_halo(
    df: DataFrame, row_no: str, width: int, reach: int, block: str = "_blk", copied: str = "_halo"
) -> DataFrame:
    """Cut a dense row numbering into blocks and copy the last ``reach`` rows of each into the next.

    Any frame of at most ``reach`` preceding rows is then complete inside ``(key, block)``; drop
    the copied rows after the window.
    """
    if reach > width:
        raise ValueError("the halo must fit into one block")
    place = F.col(row_no) - 1
    own = F.floor(place / F.lit(width)).cast("bigint")
    here = F.struct(own.alias("b"), F.lit(False).alias("h"))
    there = F.struct((own + 1).alias("b"), F.lit(True).alias("h"))
    near_end = place % width >= width - reach
    homes = F.when(near_end, F.array(here, there)).otherwise(F.array(here))
    return (
        df.withColumn("_home", F.explode(homes))
        .withColumn(block, F.col("_home.b"))
        .withColumn(copied, F.col("_home.h"))
        .drop("_home")
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap: float,
    name: str,
    tag: str | None = None,
    tie: Sequence[str] = (),
    width: float = SEGMENT_S,
) -> DataFrame:
    """Label rows with the start of their island.

    Rows are points or disjoint intervals ordered by ``start``. A new island begins where the row
    starts more than ``gap`` after the end of the row before it, or where ``tag`` changes. A row
    whose predecessor ended longer ago than ``gap`` is a break whatever the predecessor was, so
    copying the rows that reach into later segments is enough to find every break.
    """
    first = segment_of(F.col(start), width)
    last = segment_of(F.col(end) + F.lit(gap), width)
    spread = (
        df.withColumn("_first", first)
        .withColumn(SEG, F.explode(F.sequence(first, last)))
        .withColumn("_halo", F.col(SEG) > F.col("_first"))
    )
    order = [F.col(start), *map(F.col, tie)]
    w = _within(keys, order)
    fresh = F.lag(end).over(w).isNull() | (F.col(start) - F.lag(end).over(w) > F.lit(gap))
    if tag:
        fresh = fresh | (F.lag(tag).over(w) != F.col(tag))
    breaks = spread.withColumn("_fresh", fresh).filter(~F.col("_halo")).drop("_first", "_halo")
    named = last_known(breaks, keys, order, {name: F.when(F.col("_fresh"), F.col(start))})
    return named.drop(SEG, "_fresh")
