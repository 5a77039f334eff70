"""Prepared datasets: write everything once, read matches back by partition."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import schema
from touchline.operators import features, labels, orientation, possession, quality
from touchline.session import stage

_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def prepare_dataset(
    frames: DataFrame, events: DataFrame, players: DataFrame, path: str, declared: DataFrame | None = None,
    overrides: DataFrame | None = None, strict: bool = True, made: str | None = None,
) -> dict[str, str]:
    """Validate, orient, build features and labels, and write them by match.

    Context is a stage table: it feeds the report, the features and the labels. ``made`` makes the array of players from columns
    of ``frames`` that carry none; then no array is shuffled or staged. With ``strict`` unusable matches stop the job; otherwise
    their problems are in the reports.
    """
    kept = stage(quality.sort_events(quality.events_in_range(events, quality.frame_bounds(frames))))
    context = stage(possession.possession_context(frames, kept))
    seen = context.withColumn("players", F.expr(made)) if made else context
    report = stage(quality.validation_report(seen, events))
    oriented, squad = orientation.infer_orientation(seen, kept, players, declared, overrides)
    oriented = stage(oriented)
    if strict:
        quality.raise_if_fatal(report)
        orientation.require_orientation(oriented)
    # a row per match, staged so that its size is known and frames are not shuffled to meet it
    keepers = stage(squad.filter("is_goalkeeper").groupBy("match_id").agg(F.collect_set("player_id").alias("_gk")))
    table = features.match_features(context, oriented, players=made, keepers=keepers)
    schema.check_columns(table.columns)
    samples, episodes = labels.build_labels(context, oriented)
    samples = stage(samples)
    out = {name: f"{path}/{name}" for name in ("features", "samples", "episodes", "orientation", "validation", "summary")}
    write = lambda df, name: df.write.mode("overwrite").partitionBy("match_id").parquet(out[name])
    _write_unsorted(table, out["features"])
    write(samples, "samples")
    write(episodes, "episodes")
    oriented.write.mode("overwrite").json(out["orientation"])
    report.write.mode("overwrite").json(out["validation"])
    labels.label_summary(samples, episodes).withColumn("feature_schema", F.lit(schema.schema_hash())).write.mode("overwrite").json(out["summary"])
    return out


def _write_unsorted(table: DataFrame, path: str) -> None:
    """Written by match without a sort by match first, which would spill every feature once: a task has up to sixteen files open.

    A task of more matches sorts the rest. Row groups are small, since a task holds one per file.
    """
    spark = table.sparkSession
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, "16")
    try:
        table.write.mode("overwrite").option("parquet.block.size", 16 << 20).partitionBy("match_id").parquet(path)
    finally:
        spark.conf.unset(_WRITERS) if before is None else spark.conf.set(_WRITERS, before)


def load_prepared(spark: SparkSession, path: str, match_ids=None) -> DataFrame:
    """One prepared table; a list of matches prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(F.col("match_id").isin(*match_ids)) if match_ids is not None else df
