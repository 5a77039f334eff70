"""Session defaults and stage tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "touchline") -> SparkSession:
    """Session for tests and the local benchmark; on a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for stage tables: the cluster's checkpoint folder; only in local mode a private one if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once as a stage table and read it back.

    Used where a plan is read more than once (a scan and its summary). It cuts lineage, survives
    the loss of executors, and lets each reader prune to the columns it needs.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
