"""Forward-blind possession state: what was knowable from events at each frame.

Events and frames of one match share a timeline cut into segments of frame numbers. Runs of
possession are found on the (much smaller) event table, the state on entry to every segment comes
from an event summary per segment, and each frame then reads its state from one window inside its
segment: frames are shuffled once.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline import constants as C
from touchline.functions import events as ev
from touchline.plans import segments
from touchline.plans.segments import SEG, SEGMENT_ROWS

ORDER = ["start_frame", "event_seq"]


def _segmented(events: DataFrame, width: int) -> DataFrame:
    return events.withColumn(SEG, segments.segment_of(F.col("start_frame"), width))


def _in_segment(events: DataFrame) -> DataFrame:
    """Per segment: on-ball index and the team changes that are visible without earlier segments."""
    on_ball = ev.is_on_ball(F.col("type"))
    w = Window.partitionBy("match_id", SEG).orderBy(*ORDER)
    return (
        events.withColumn("_on", on_ball)
        .withColumn("_i", F.sum(on_ball.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(
            "_before",
            F.last(F.when(on_ball, F.col("team")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        )
    )


def _segment_states(events: DataFrame) -> DataFrame:
    """One row per segment that has events: possession, latest event and play at its start and end."""
    kind, on = F.col("type"), F.col("_on")
    place = F.struct(*ORDER)
    changed = on & (F.col("_before") != F.col("team"))
    dead = ev.is_dead_ball(kind)
    ends = _in_segment(events).groupBy("match_id", SEG).agg(
        F.sum(on.cast("int")).alias("_n"),
        F.min_by(F.struct("team", "start_frame"), F.when(on, place)).alias("_first"),
        F.max_by("team", F.when(on, place)).alias("_last_team"),
        F.max_by(F.struct(F.col("start_frame").alias("start"), F.col("_i").alias("i")), F.when(changed, place)).alias("_turn"),
        F.max_by(F.struct(kind.alias("type"), F.col("end_frame")), place).alias("_latest"),
        F.max_by(dead, F.when(on | dead, place)).alias("_dead"),
    )
    per_match = Window.partitionBy("match_id").orderBy(SEG)
    earlier = per_match.rowsBetween(Window.unboundedPreceding, -1)
    upto = per_match.rowsBetween(Window.unboundedPreceding, 0)
    team_in = F.last("_last_team", ignorenulls=True).over(earlier)
    opens = F.col("_first").isNotNull() & (F.col("_team_in").isNull() | (F.col("_team_in") != F.col("_first.team")))
    first_turn = F.when(opens, F.struct(F.col("_first.start_frame").alias("start"), F.lit(1).cast("bigint").alias("i")))
    turned = (
        ends.withColumn("_team_in", team_in)
        .withColumn("_prior", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_turn", F.coalesce("_turn", first_turn))
        .withColumn("_mark", F.when(F.col("_turn").isNotNull(), F.struct(
            F.col("_turn.start").alias("start"), (F.col("_prior") + F.col("_turn.i") - 1).alias("at"))))
    )
    mark = F.last("_mark", ignorenulls=True)
    held = F.last("_last_team", ignorenulls=True).over(upto)
    return turned.select(
        "match_id", SEG, "_team_in",
        mark.over(earlier)["start"].alias("_start_in"),
        (F.col("_prior") - mark.over(earlier)["at"]).alias("_count_in"),
        held.alias("_team_out"),
        mark.over(upto)["start"].alias("_start_out"),
        (F.col("_prior") + F.col("_n") - mark.over(upto)["at"]).alias("_count_out"),
        F.last("_latest", ignorenulls=True).over(upto).alias("_latest_out"),
        F.last("_dead", ignorenulls=True).over(upto).alias("_dead_out"),
        F.lead(SEG).over(per_match).alias("_next"),
    )


def possession_runs(events: DataFrame, width: int = SEGMENT_ROWS) -> DataFrame:
    """On-ball events with the start frame of their team's unbroken run and the run's count so far.

    Other events are stepped over: they neither end a run nor start one.
    """
    on_ball = _segmented(events.filter(ev.is_on_ball(F.col("type"))), width)
    carried = _segment_states(on_ball).select("match_id", SEG, "_team_in", "_start_in", "_count_in")
    rows = _in_segment(on_ball).join(carried, ["match_id", SEG])
    before = F.coalesce("_before", "_team_in")
    upto = Window.partitionBy("match_id", SEG).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    turn = F.last(F.when(F.col("_fresh"), F.struct("start_frame", "_i")), ignorenulls=True).over(upto)
    return rows.withColumn("_fresh", before.isNull() | (before != F.col("team"))).select(
        *events.columns,
        F.coalesce(turn["start_frame"], F.col("_start_in")).alias("run_start"),
        F.coalesce(F.col("_i") - turn["_i"] + 1, F.col("_count_in") + F.col("_i")).alias("run_events"),
    )


def _entry_rows(states: DataFrame, last_frames: DataFrame, width: int) -> DataFrame:
    """The state on entry to each segment after the first event, as one timeline row per segment."""
    bounds = last_frames.select("match_id", segments.segment_of(F.col("last_frame"), width).alias("_stop"))
    stop = F.coalesce("_next", "_stop")
    return (
        states.join(bounds, "match_id")
        .filter(stop > F.col(SEG))
        .withColumn(SEG, F.explode(F.sequence(F.col(SEG) + 1, stop)))
        .select(
            "match_id", SEG, (F.col(SEG) * width).alias("_f"), F.lit(0).alias("_kind"),
            F.lit(-1).cast("bigint").alias("_seq"),
            F.col("_team_out").alias("_team"),
            F.when(F.col("_team_out").isNotNull(), F.struct(
                F.col("_start_out").alias("start"), F.lit(0).cast("bigint").alias("i"),
                F.col("_count_out").alias("n"))).alias("_base"),
            F.col("_latest_out").alias("_latest"), F.col("_dead_out").alias("_dead"),
        )
    )


def possession_context(
    frames: DataFrame, events: DataFrame, last_frames: DataFrame | None = None,
    width: int = SEGMENT_ROWS, frame_rate: float = C.FRAME_RATE,
    recent_frames: int = C.RECENT_PASS_FRAMES,
) -> DataFrame:
    """Frames with possession team, duration, run count, dead ball, in flight, recent progress count.

    ``is_dead_ball`` looks at the latest event of any type; ``in_stoppage`` lasts from a dead-ball
    event to the next on-ball event. The two differ when, say, a challenge follows a ball out.
    ``last_frames(match_id, last_frame)`` saves a pass over the frames when it is already known.
    """
    if last_frames is None:
        last_frames = frames.groupBy("match_id").agg(F.max("frame").alias("last_frame"))
    timed = _segmented(events, width)
    kind = F.col("type")
    on, dead = ev.is_on_ball(kind), ev.is_dead_ball(kind)
    progress = kind.isin(*C.PROGRESS_TYPES).cast("int")
    columns = [c for c in frames.columns if c != "match_id"]
    rows = frames.select(
        "match_id", segments.segment_of(F.col("frame"), width).alias(SEG),
        F.col("frame").alias("_f"), F.lit(2).alias("_kind"), F.lit(0).cast("bigint").alias("_seq"),
        F.struct(*columns).alias("_row"),
    )
    # the state on entry sorts first, then the events of a frame, then the frame itself
    entry = _entry_rows(_segment_states(timed), last_frames, width)
    # a progress event counts from its frame until it leaves the lookback: +1, later -1, in its own
    # segment and in the ones its lookback reaches
    leaves = F.col("start_frame") + recent_frames + 1
    reach = F.floor(leaves / F.lit(width)).cast("bigint")
    plus = F.struct(F.lit(1).alias("d"), F.col("start_frame").alias("f"))
    minus = F.struct(F.lit(-1).alias("d"), leaves.alias("f"))
    counts = F.transform(F.sequence(F.col(SEG), reach), lambda g: F.struct(g.alias("g"), plus.alias("at")))
    uncounts = F.array(F.struct(reach.alias("g"), minus.alias("at")))
    nothing = F.array(F.struct(F.col(SEG).alias("g"), F.struct(F.lit(0).alias("d"), F.col("start_frame").alias("f")).alias("at")))
    homes = F.when(progress == 1, F.concat(counts, uncounts)).otherwise(nothing)
    placed = timed.withColumn("_p", F.explode(homes)).withColumn(
        "_own", (F.col("_p.g") == F.col(SEG)) & (F.col("_p.at.d") >= 0)
    )
    own = placed.select(
        "match_id", F.col("_p.g").alias(SEG), F.col("_p.at.f").alias("_f"), F.lit(1).alias("_kind"),
        F.col("event_seq").alias("_seq"), F.col("_p.at.d").alias("_progress"),
        F.when(F.col("_own") & on, F.col("team")).alias("_team"),
        F.when(F.col("_own"), F.struct(kind.alias("type"), F.col("end_frame"))).alias("_latest"),
        F.when(F.col("_own") & (on | dead), dead).alias("_dead"),
    )
    timeline = rows.unionByName(own, allowMissingColumns=True).unionByName(entry, allowMissingColumns=True)
    ordered = Window.partitionBy("match_id", SEG).orderBy("_f", "_kind", "_seq")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("_team", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    is_event = F.coalesce((F.col("_kind") == 1) & F.col("_team").isNotNull(), F.lit(False))
    indexed = timeline.withColumn("_was", before).withColumn("_i", F.sum(is_event.cast("int")).over(upto))
    turn = is_event & (F.col("_was").isNull() | (F.col("_was") != F.col("_team")))
    fresh = F.struct(F.col("_f").alias("start"), F.col("_i").alias("i"), F.lit(1).cast("bigint").alias("n"))
    state = indexed.withColumn("_base", F.when(turn, fresh).otherwise(F.col("_base"))).select(
        "match_id", "_kind", "_row", "_f", "_i",
        *[F.last(s, ignorenulls=True).over(upto).alias(s) for s in ("_team", "_base", "_latest", "_dead")],
        F.sum("_progress").over(upto).alias("_recent"),
    ).filter(F.col("_kind") == 2)
    base = F.col("_base")
    elapsed = (F.col("_f") - base["start"]).cast("double") / F.lit(frame_rate)
    return state.select(
        "match_id",
        *[F.col("_row")[c].alias(c) for c in columns],
        F.col("_team").alias("possession_team"),
        F.coalesce(F.greatest(elapsed, F.lit(0.0)), F.lit(0.0)).alias("possession_duration_s"),
        F.coalesce(base["n"] + F.col("_i") - base["i"], F.lit(0)).cast("bigint").alias("possession_event_count"),
        F.coalesce(ev.is_dead_ball(F.col("_latest")["type"]), F.lit(False)).alias("is_dead_ball"),
        F.coalesce(F.col("_latest")["end_frame"] > F.col("_f"), F.lit(False)).alias("event_in_flight"),
        F.coalesce("_dead", F.lit(False)).alias("in_stoppage"),
        F.coalesce("_recent", F.lit(0)).cast("bigint").alias("recent_pass_count"),
    )


def visible_events(frames: DataFrame, events: DataFrame, lookback_frames: int) -> DataFrame:
    """Events started in ``[frame - lookback, frame]``, outcome fields hidden until they end.

    One row per frame and visible event: both sides meet in buckets of the lookback length, so no
    bucket pairs more than the rows that can match.
    """
    width = max(int(lookback_frames), 1)
    bucket = F.floor(F.col("start_frame") / F.lit(width)).cast("bigint")
    right = events.withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
    left = frames.select("match_id", "frame", F.floor(F.col("frame") / F.lit(width)).cast("bigint").alias("_b"))
    seen = F.col("start_frame").between(F.col("frame") - lookback_frames, F.col("frame"))
    joined = left.join(right, ["match_id", "_b"]).filter(seen)
    outcome = [c for c in ("end_frame", "end_time_s", "end_x", "end_y", "to_player") if c in events.columns]
    others = [c for c in events.columns if c not in outcome and c not in ("match_id", "_b")]
    return joined.select(
        "match_id", "frame", *others,
        (F.col("end_frame") <= F.col("frame")).alias("resolved"),
        *[ev.redact(F.col("frame"), F.col("end_frame"), F.col(c)).alias(c) for c in outcome],
    )


def recent_type_counts(
    frames: DataFrame, events: DataFrame, lookback_frames: int, team: str | None = None
) -> DataFrame:
    """Visible events per frame and type, absent types omitted."""
    chosen = events if team is None else events.filter(F.col("team") == team)
    return (
        visible_events(frames, chosen, lookback_frames)
        .groupBy("match_id", "frame", "type").agg(F.count(F.lit(1)).alias("n_events"))
    )
