"""Canonical match tables derived from the star-schema test tables.

``lineitem`` rows become 25 Hz frames of four matches (two halves each), ``events`` rows become the
annotated event stream. The mapping is plain arithmetic, so the same rows follow from any engine.
Everything here is lazy and keyed so that no match is ever numbered inside one task.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.plans import segments

MATCHES = 4
#: order keys per numbering bucket inside one ship date
ORDERS_PER_BUCKET = 1 << 23

#: (team, slot, p, q): slot positions are fixed multiples of the frame's part key and number
SLOTS = (
    ("home", 0, 7, 3), ("home", 1, 11, 5), ("home", 2, 13, 17), ("home", 3, 19, 23), ("home", 4, 29, 2),
    ("away", 0, 31, 7), ("away", 1, 37, 11), ("away", 2, 41, 3), ("away", 3, 43, 13), ("away", 4, 47, 19),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def match_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames per match."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % MATCHES).alias("match_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _numbered(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % MATCHES).alias("match_id"),
        F.col("l_shipdate"),
        F.floor(F.col("l_orderkey") / F.lit(ORDERS_PER_BUCKET)).alias("_slice"),
        "l_orderkey", "l_linenumber", "l_partkey", *columns,
    )
    return segments.number_rows(
        lines, ["match_id"], ["l_shipdate", "_slice"],
        ["l_orderkey", "l_linenumber", "l_partkey"], name="frame", total="n",
    )


def frames(spark: SparkSession, sf_dir: str, players: bool = False, source: bool = False) -> DataFrame:
    """match_id, period, frame, time_s, ball_x, ball_y, row_no, period_row (, players) (, the source column of PLAYERS)."""
    rows = _numbered(spark, sf_dir, "l_quantity", "l_discount", "l_tax")
    tracked = "CASE WHEN l_tax <> 0D THEN"
    return rows.selectExpr(
        "match_id", "CASE WHEN 2 * frame <= n THEN 1 ELSE 2 END AS period", "frame",
        "cast(frame AS double) / 25D AS time_s",
        f"{tracked} (l_quantity - 25.5D) / 24.5D * 52.5D END AS ball_x",
        f"{tracked} (l_discount - 0.05D) / 0.05D * 34D END AS ball_y",
        "frame AS row_no",
        "CASE WHEN 2 * frame <= n THEN frame ELSE frame - floor(n / 2) END AS period_row",
        *([f"{PLAYERS} AS players"] if players else []), *(["l_partkey"] if source else []),
    )


def _players() -> str:
    def slot(team, s, p, q):
        absent = f"(l_partkey + {s}) % 11 = 0"
        x = f"cast((l_partkey * {p} + frame * {q}) % 1050 AS double) / 10D - 52.5D"
        y = f"cast((l_partkey * {q} + frame * {p}) % 680 AS double) / 10D - 34D"
        return (
            f"struct('{team}' AS team, '{team}_{s}' AS player_id, {str(s == 0).lower()} AS is_gk, "
            f"CASE WHEN NOT {absent} THEN {x} END AS x, CASE WHEN NOT {absent} THEN {y} END AS y)"
        )

    return f"array({', '.join(slot(*s) for s in SLOTS)})"


#: the array of players of a frame, from ``l_partkey`` and ``frame``: taken where it is read, it is never shuffled
PLAYERS = _players()


def players(spark: SparkSession, declared: bool = True) -> DataFrame:
    """Squad of every match; without ``declared`` nobody is marked as goalkeeper."""
    rows = [
        (m, team, f"{team}_{s}", s, None, declared and s == 0, "declared" if declared and s == 0 else "unknown")
        for m in range(MATCHES)
        for team, s, _, _ in SLOTS
    ]
    return spark.createDataFrame(
        rows,
        "match_id bigint, team string, player_id string, shirt_number int, position_type string, "
        "is_goalkeeper boolean, goalkeeper_source string",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, event_seq, team, type, period, start/end frame and time, start/end position."""
    # at most MATCHES rows
    sizes = match_sizes(spark, sf_dir).withColumn("_shortest", F.min("n").over(Window.partitionBy(F.lit(0))))
    metres = lambda a, b, span, half: (
        f"CASE WHEN event_id % 17 <> 0 THEN cast((event_id * {a} + user_id * {b}) % {span} AS double) / 10D - {half}D END")
    taxonomy = (
        "CASE WHEN event_id % 10 = 3 THEN 'challenge' WHEN event_id % 10 = 7 THEN 'ball_lost' "
        "WHEN event_type = 'click' THEN 'pass' WHEN event_type = 'view' THEN 'carry' "
        "WHEN event_type = 'purchase' THEN 'shot' WHEN event_type = 'signup' THEN 'recovery' ELSE 'ball_out' END"
    )
    start = "1 + (event_id * 13) % _shortest"
    return (
        read(spark, sf_dir, "events").withColumn("match_id", F.expr(f"user_id % {MATCHES}")).join(sizes, "match_id")
        .selectExpr("*", f"{start} AS start_frame", f"{start} + event_id % 40 AS end_frame")
        .selectExpr(
            "match_id", "event_id AS event_seq", "CASE WHEN user_id % 8 < 4 THEN 'home' ELSE 'away' END AS team",
            f"{taxonomy} AS type", "start_frame", f"{metres(37, 0, 1050, 52.5)} AS start_x",
            f"{metres(53, 0, 680, 34.0)} AS start_y", f"{metres(41, 1, 1050, 52.5)} AS end_x",
            f"{metres(59, 1, 680, 34.0)} AS end_y", "CASE WHEN 2 * start_frame <= n THEN 1 ELSE 2 END AS period",
            "end_frame", "cast(start_frame AS double) / 25D AS start_time_s", "cast(end_frame AS double) / 25D AS end_time_s",
        )
    )


def orientation(spark: SparkSession) -> DataFrame:
    """Home attacks +x in the first half; teams change ends."""
    rows = [
        (m, period, team, 1 if (team == "home") == (period == 1) else -1)
        for m in range(MATCHES) for period in (1, 2) for team in ("home", "away")
    ]
    return spark.createDataFrame(rows, "match_id bigint, period int, team string, sign int")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored windows every half second: match_id, row_no, time_s, team, probability, label."""
    return _numbered(spark, sf_dir, "l_quantity", "l_discount").selectExpr(
        "match_id", "frame AS row_no", "frame * 0.5D AS time_s", "floor(frame / 40D) % 2 AS team",
        "floor(l_quantity) / 50D AS probability", "CASE WHEN l_discount >= 0.08D THEN 1 ELSE 0 END AS label",
    )


def last_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_sizes(spark, sf_dir).withColumnRenamed("n", "last_frame")
