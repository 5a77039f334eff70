"""Sizes of the Arrow batches that reach Python."""

from pyspark.sql import DataFrame

#: rows and bytes of a batch: a task holds a few copies of one at a time, beside the JVM's own
ROWS, BYTES = 1000, 4 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` itself; its session makes batches of ROWS and BYTES at most from now on, for texts are long."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = int("".join(c for c in conf.get(key) if c.isdigit()) or 0)
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return df
