"""Viewer and report sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_payload(frames: DataFrame, lap: int = 0, speed: float = 1.0) -> DataFrame:
    """Viewer record of each frame as a struct: rounded positions, NULL for absent, side as a flag.

    ``frames``: context with players, joined with probability, window_valid, attacking_team, sign, reason.
    """
    where = "CASE WHEN p.x IS NOT NULL AND p.y IS NOT NULL THEN array(bround(p.x, 2), bround(p.y, 2)) END"
    side = lambda t: f"transform(filter(players, p -> p.team = '{t}'), p -> {where})"
    return frames.selectExpr(
        "match_id", "frame",
        f"""struct(period, bround(time_s, 2) AS match_time_s, frame, {lap} AS lap, match_id AS fixture, {float(speed)!r}D AS speed,
        {side('home')} AS home, {side('away')} AS away,
        CASE WHEN ball_x IS NOT NULL AND ball_y IS NOT NULL THEN array(bround(ball_x, 2), bround(ball_y, 2)) END AS ball,
        CASE WHEN window_valid THEN bround(probability, 4) END AS probability, coalesce(window_valid, false) AS window_valid,
        attacking_team, sign > 0 AS attacking_right, reason AS suppression) AS payload""")


def insight_record(outcomes: DataFrame) -> DataFrame:
    """Emitted insights as records."""
    fields = [c for c in ("kind", "headline", "detail", "probability", "time_s", "period", "team", "facts", "emitted_at_s") if c in outcomes.columns]
    return outcomes.filter("emitted").select("match_id", F.struct(*fields).alias("insight"))


def as_json(records: DataFrame, column: str) -> DataFrame:
    """Records as JSON text, NULL fields kept."""
    return records.select("match_id", F.to_json(column, {"ignoreNullFields": "false"}).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    """Direction, drift and cross-validation reports."""
    df.write.mode("overwrite").json(path)
