"""Events CSV with a header row."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import events as ev
from touchline.functions import geometry as geo
from touchline.plans import segments

REQUIRED = ("Team", "Type", "Period", "Start Frame", "Start Time [s]")
OPTIONAL = ("Subtype", "End Frame", "End Time [s]", "From", "To", "Start X", "Start Y", "End X", "End Y")


def read_events(spark: SparkSession, path, match_id: Column | str) -> DataFrame:
    """Canonical events; rows of neither team are dropped, ends default to starts."""
    raw = spark.read.option("header", True).csv(path)
    missing = sorted(set(REQUIRED) - set(raw.columns))
    if missing:
        raise ValueError(f"events file is missing columns {missing}")
    key = F.lit(match_id) if isinstance(match_id, str) else match_id
    rows = raw.select(
        key.alias("match_id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"),
        *[F.trim(F.coalesce(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string"), F.lit(""))).alias(c) for c in REQUIRED + OPTIONAL],
    )
    numbered = segments.number_rows(rows, ["match_id"], ["_file", "_block"], ["_line"], name="event_seq")
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    # an empty start counts as zero, anything else has to be a number
    start_frame = F.coalesce(text("Start Frame").cast("double"), F.lit(0.0)).cast("bigint")
    start_s = F.coalesce(text("Start Time [s]").cast("double"), F.lit(0.0))
    end_frame = text("End Frame").cast("double").cast("bigint")
    raw_type = F.upper(F.col("Type"))
    team = F.lower(F.col("Team"))
    frames = numbered.filter(team.isin("home", "away")).select(
        "match_id", "event_seq", team.alias("team"), ev.event_type(raw_type).alias("type"), text("Subtype").alias("subtype"),
        F.col("Period").cast("int").alias("period"), start_frame.alias("start_frame"),
        ev.end_not_before(start_frame, end_frame).alias("end_frame"), start_s.alias("start_time_s"),
        F.greatest(start_s, F.coalesce(text("End Time [s]").cast("double"), start_s)).alias("end_time_s"),
        text("From").alias("from_player"), text("To").alias("to_player"),
        *[ev.try_number(F.col(c)).alias(a) for c, a in (("Start X", "_sx"), ("Start Y", "_sy"), ("End X", "_ex"), ("End Y", "_ey"))],
        raw_type.alias("raw_type"),
    )
    return place(frames)


def place(rows: DataFrame) -> DataFrame:
    """Source positions ``_sx _sy _ex _ey`` to metres; half a position is no position."""
    for side, u, v in (("start", "_sx", "_sy"), ("end", "_ex", "_ey")):
        both = F.col(u).isNotNull() & F.col(v).isNotNull()
        rows = rows.withColumn(f"{side}_x", F.when(both, geo.to_canonical_x(F.col(u)))).withColumn(
            f"{side}_y", F.when(both, geo.to_canonical_y(F.col(v))))
    return rows.drop("_sx", "_sy", "_ex", "_ey")


def write_events(events: DataFrame, path: str) -> None:
    """Back to the CSV layout: unit square, two decimals of time, files under ``match_id=…``."""
    unit = lambda c: F.coalesce(F.format_string("%.5f", c), F.lit(""))
    raw = F.upper(F.replace(F.col("type"), F.lit("_"), F.lit(" ")))
    optional = lambda c: F.coalesce(F.col(c), F.lit("")) if c in events.columns else F.lit("")
    rows = events.select(
        "match_id", F.initcap("team").alias("Team"), raw.alias("Type"), optional("subtype").alias("Subtype"), F.col("period").alias("Period"),
        F.col("start_frame").alias("Start Frame"), F.format_string("%.2f", "start_time_s").alias("Start Time [s]"),
        F.col("end_frame").alias("End Frame"), F.format_string("%.2f", "end_time_s").alias("End Time [s]"),
        optional("from_player").alias("From"), optional("to_player").alias("To"),
        unit(geo.to_unit_x(F.col("start_x"))).alias("Start X"), unit(geo.to_unit_y(F.col("start_y"))).alias("Start Y"),
        unit(geo.to_unit_x(F.col("end_x"))).alias("End X"), unit(geo.to_unit_y(F.col("end_y"))).alias("End Y"),
    )
    rows.write.mode("overwrite").partitionBy("match_id").option("header", True).option("emptyValue", "").csv(path)
