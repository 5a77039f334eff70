"""Slices of a value's range that hold about as many rows each, whatever the distribution.

Equal-width slices of a heavy-tailed value put nearly all rows into one. Here the splitters come from a quantile sketch
that merges over partitions (``percentile_approx``), and a value that is a splitter itself is a slice of its own, which a
second column cuts further where many rows share it. Slices only deal out work: ranks and quantiles inside them stay exact.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import stage

#: slices of a key; the sketch is sixteen times as fine
SLICES = 256


def sketch(value, slices: int = SLICES) -> Column:
    """Aggregate: ascending splitters of ``value``, at most ``slices - 1``."""
    return F.array_distinct(F.percentile_approx(value, [i / slices for i in range(1, slices)], 16 * slices))


def slice_of(value: Column, splitters: Column, slices: int = SLICES) -> Column:
    """Number of the slice of ``value``, by binary search: even for a splitter, odd for what lies between two."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((slices - 1).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(splitters, at + step - 1) <= value, step).otherwise(0))
    # the search stands in an array of one so that it is written once in the expression
    return F.get(F.transform(F.array(found), lambda i: 2 * i + F.when(F.get(splitters, i - 1) == value, 0).otherwise(1)), 0).cast("bigint")


def sliced(df: DataFrame, keys: Sequence[str], value: str, name: str, tie: str | None = None, tie_width: float = 16384, slices: int = SLICES) -> DataFrame:
    """Adds ``name`` (slice of ``value`` per key) and, with ``tie``, ``name``_tie: for rows on a splitter the slice of ``tie``, else 0."""
    keys = list(keys)
    if not keys:
        return sliced(df.withColumn("_all", F.lit(0)), ["_all"], value, name, tie, tie_width, slices).drop("_all")
    # scans read the slices twice, and a sketch merged again in another order has other splitters
    found = stage(df.groupBy(*keys).agg(sketch(value, slices).alias("_splitters")))
    out = df.join(found, keys).withColumn(name, slice_of(F.col(value), F.col("_splitters"), slices)).drop("_splitters")
    if tie:
        out = out.withColumn(f"{name}_tie", F.when(F.col(name) % 2 == 0, F.floor(F.col(tie) / F.lit(tie_width)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out
