"""Run a stream over a table to its end: for backfills, tests and the registered queries."""

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from touchline.session import stage_dir
from touchline.streaming.ordered import BLOCK_MS, HEARTBEAT, timed

#: input of a micro-batch; a key takes it an Arrow batch at a time, so it bounds the state written at once, not memory
BYTES_PER_TRIGGER = 256 << 20
#: the state store that ``transformWithState`` needs
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEY, _PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
#: a gathered block is one long row, so Arrow batches are bounded by bytes
BATCH_BYTES, _BATCH_BYTES = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def run_to_end(source: DataFrame, transform, delay_ms: int | None = None, operators: int = 1, files_per_trigger: int | None = None, sink=None) -> DataFrame:
    """Write ``source`` (with ``at_ms``), stream its files in whatever order they are listed through ``transform``, return what came out.

    Rows may lag ``delay_ms`` behind the newest; the default is the table's whole span, so that no order of its files is too late
    (the rows then wait in the state store, on disk). A heartbeat after the last file lets ``operators`` chained ones finish.
    ``sink(batch, id)`` gets each micro-batch instead of a table, which is then returned empty.
    """
    spark = source.sparkSession
    base = f"{stage_dir(spark)}/stream-{uuid.uuid4().hex}"
    source.write.parquet(f"{base}/in")
    written = spark.read.schema(source.schema).parquet(f"{base}/in")
    match, first, last, matches = written.agg(F.min("match_id"), F.min("at_ms"), F.max("at_ms"), F.approx_count_distinct("match_id")).first()
    first, last = first or 0, last or 0
    delay_ms = last - first + 1 if delay_ms is None else delay_ms
    most = ("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else ("maxBytesPerTrigger", BYTES_PER_TRIGGER)
    stream = spark.readStream.schema(written.schema).option(*most).parquet(f"{base}/in")
    out = transform(timed(stream, F.col("at_ms"), f"{delay_ms} milliseconds"))
    # a partition of state more than there are cores or matches is opened and closed each batch for nothing
    partitions = min(int(spark.conf.get(_PARTITIONS)), max(spark.sparkContext.defaultParallelism, matches))
    before = {k: spark.conf.get(k, None) for k in (_KEY, _PARTITIONS, _BATCH_BYTES)}
    spark.conf.set(_KEY, PROVIDER)
    spark.conf.set(_PARTITIONS, str(partitions))
    spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    try:
        _to_end(out, base, sink)
        beat = spark.range(1).select(F.lit(match or 0).cast("bigint").alias("match_id"), F.lit(last + delay_ms + (operators + 2) * BLOCK_MS).cast("bigint").alias("at_ms"), F.lit(HEARTBEAT).alias("control"))
        beat.select(*[(F.col(f.name) if f.name in beat.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in written.schema]).write.mode("append").parquet(f"{base}/in")
        _to_end(out, base, sink)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if sink:
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).parquet(f"{base}/out").filter("control IS NULL").drop("at", "at_ms", "control")


def _to_end(out: DataFrame, base: str, sink) -> None:
    writer = out.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", f"{base}/out").start()
    query.awaitTermination()


class MetricsTable(StreamingQueryListener):
    """Observed metrics of one name, a row a micro-batch: a batch that reports again replaces its own row."""

    def __init__(self, spark: SparkSession, path: str, name: str = "live"):
        self.spark, self.path, self.name = spark, path, name
        self.ended = threading.Semaphore(0)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        metrics = event.progress.observedMetrics.get(self.name)
        if metrics is None:
            return
        row = (str(event.progress.id), event.progress.batchId, json.dumps(metrics.asDict()))
        rows = self.spark.createDataFrame([row], "query string, batch bigint, metrics string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/query={row[0]}/batch={row[1]}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.release()

    def read(self, schema: str) -> DataFrame:
        """query, batch and the metrics by ``schema``."""
        rows = self.spark.read.schema("query string, batch bigint, metrics string").parquet(f"{self.path}/query=*/batch=*")
        return rows.select("query", "batch", F.from_json("metrics", schema).alias("m")).select("query", "batch", "m.*")


def with_metrics(spark: SparkSession, name: str, run) -> MetricsTable:
    """The table of metrics that the two parts of ``run()`` report."""
    table = MetricsTable(spark, f"{stage_dir(spark)}/metrics-{uuid.uuid4().hex}", name)
    spark.streams.addListener(table)
    try:
        run()
        for _ in range(2):  # progress is told before the end
            table.ended.acquire(timeout=60)
    finally:
        spark.streams.removeListener(table)
    return table


def route_messages(path: str, kinds: tuple[str, ...], kind: str = "type"):
    """``foreachBatch`` sink: a table a kind of message, ``path/<kind>``, in folders of the batch they came in.

    A batch that is written again replaces its own folder of every table, so nothing is there twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        for name in kinds:
            held.filter(F.col(kind) == name).drop(kind).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        held.unpersist()

    return write
