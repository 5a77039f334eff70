"""Entries, episodes, possession clusters and labelled samples."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline import constants as C
from touchline.functions import geometry as geo
from touchline.operators.features import signs
from touchline.plans import segments
from touchline.plans.anchored import anchored_groups
from touchline.plans.segments import SEG, SEGMENT_ROWS
from touchline.session import stage


def ball_inside(context: DataFrame, orientation: DataFrame) -> DataFrame:
    """Slim frames with ``inside``: ball in the box attacked by the team in possession."""
    sign = F.when(F.col("possession_team") == "home", F.col("home_sign")).when(
        F.col("possession_team") == "away", F.col("away_sign"))
    inside = geo.in_box(F.col("ball_x") * sign, F.col("ball_y") * sign)
    return context.join(signs(orientation), ["match_id", "period"]).select(
        "match_id", "period", "frame", "row_no", "period_row", "time_s",
        F.col("possession_team").alias("team"), "in_stoppage", inside.alias("inside"),
    )


def _with_lag(rows: DataFrame, columns: dict[str, str], width: int = SEGMENT_ROWS) -> DataFrame:
    """Value of the preceding frame of the match (halves follow on)."""
    w = Window.partitionBy("match_id", "_blk").orderBy("row_no")
    out = segments.with_halo(rows, "row_no", width, 1)
    for name, column in columns.items():
        out = out.withColumn(name, F.lag(column).over(w))
    return out.filter(~F.col("_halo")).drop("_halo", "_blk")


def find_entries(inside: DataFrame) -> DataFrame:
    """Rising edges of ``inside``: match_id, team, period, time_s, frame, row_no."""
    edge = F.col("inside") & ~F.coalesce("_was", F.lit(False))
    return (
        _with_lag(inside, {"_was": "inside"}).filter(edge & F.col("team").isNotNull())
        .select("match_id", "team", "period", "time_s", "frame", "row_no")
    )


def merge_episodes(entries: DataFrame, merge_gap_s: float = C.MERGE_GAP_S, block_s: float | None = None) -> DataFrame:
    """An entry joins the open episode of its team within ``merge_gap_s`` of that episode's first entry."""
    grouped = anchored_groups(entries, ["match_id"], "time_s", "row_no", merge_gap_s, tag="team", block_s=block_s)
    return grouped.groupBy("match_id", F.col("anchor_s").alias("entry_time_s")).agg(
        F.first("team").alias("team"),
        F.min_by("period", "time_s").alias("period"),
        F.count(F.lit(1)).alias("n_entries"),
    )


def number_episodes(episodes: DataFrame) -> DataFrame:
    """0-based ``episode_id`` per match in time order."""
    rows = episodes.withColumn(SEG, segments.segment_of(F.col("entry_time_s"), segments.SEGMENT_S))
    numbered = segments.number_rows(rows, ["match_id"], [SEG], ["entry_time_s"], name="_no")
    return numbered.withColumn("episode_id", F.col("_no") - 1).drop(SEG, "_no")


def possession_clusters(rows: DataFrame, width: int = SEGMENT_ROWS) -> DataFrame:
    """Adds ``cluster_id``: 0-based count of changes of the possessing team, unknown being a value.

    ``rows`` is read twice (changes per segment, then rows): pass a stage table.
    """
    changed = (F.col("row_no") > 1) & ~F.col("team").eqNullSafe(F.col("_prev"))
    lagged = _with_lag(rows, {"_prev": "team"}, width).withColumn("_change", changed.cast("int"))
    lagged = lagged.withColumn(SEG, segments.segment_of(F.col("row_no"), width))
    return segments.running_sum(lagged, ["match_id"], ["row_no"], {"cluster_id": F.col("_change")}).drop(
        SEG, "_change", "_prev")


def stride_rows(rows: DataFrame, observation: int = C.OBSERVATION_FRAMES, stride: int = C.STRIDE_FRAMES) -> DataFrame:
    """Rows of a half at which a prediction is made: the first with a full window, then every stride."""
    place = F.col("period_row") - 1 - observation
    return rows.filter((place >= 0) & (place % stride == 0))


def attach_next_episode(samples: DataFrame, episodes: DataFrame, horizon_s: float = C.HORIZON_S) -> DataFrame:
    """Earliest episode of the sample's team with ``t < entry <= t + horizon``: label and episode_id.

    Episodes are listed under the one or two horizon-long buckets they can label, so each sample
    meets one short list.
    """
    entry = F.col("entry_time_s")
    bucket = lambda t: F.floor(t / F.lit(horizon_s)).cast("bigint")
    lists = (
        episodes.withColumn("_b", F.explode(F.sequence(bucket(entry) - 1, bucket(entry))))
        .groupBy("match_id", "team", "_b")
        .agg(F.array_sort(F.collect_list(F.struct("entry_time_s", "episode_id"))).alias("_next"))
    )
    t = F.col("time_s")
    ahead = F.filter("_next", lambda e: (e["entry_time_s"] > t) & (e["entry_time_s"] <= t + F.lit(horizon_s)))
    joined = samples.withColumn("_b", bucket(t)).join(lists, ["match_id", "team", "_b"], "left")
    hit = F.get(ahead, F.lit(0))
    return (
        joined.withColumn("_hit", hit)
        .withColumn("label", F.col("_hit").isNotNull().cast("int"))
        .withColumn("episode_id", F.coalesce(F.col("_hit.episode_id"), F.lit(-1)).cast("bigint"))
        .drop("_b", "_next", "_hit")
    )


def build_labels(
    context: DataFrame, orientation: DataFrame, merge_gap_s: float = C.MERGE_GAP_S, horizon_s: float = C.HORIZON_S
) -> tuple[DataFrame, DataFrame]:
    """(samples, episodes). The slim frames and the entries become stage tables: both are read again."""
    inside = stage(ball_inside(context, orientation))
    episodes = stage(number_episodes(merge_episodes(stage(find_entries(inside)), merge_gap_s)))
    # clusters count every frame of the match, so number them before sampling
    rows = stride_rows(possession_clusters(inside))
    usable = ~F.col("in_stoppage") & F.col("team").isNotNull() & ~F.col("inside")
    samples = attach_next_episode(rows.filter(usable), episodes, horizon_s)
    return samples.select(
        "match_id", "period", "frame", "row_no", "period_row", "time_s", "team",
        "label", "episode_id", "cluster_id",
    ), episodes


def label_summary(samples: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per match: samples, positives, rate, clusters, and episodes by team."""
    by_sample = samples.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("label").alias("positives"),
        F.round(F.avg("label"), 5).alias("positive_rate"), F.countDistinct("cluster_id").alias("clusters"),
    )
    by_episode = episodes.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if(F.col("team") == "home").alias("episodes_home"),
        F.count_if(F.col("team") == "away").alias("episodes_away"),
    )
    return by_sample.join(by_episode, "match_id", "left").fillna(0)
