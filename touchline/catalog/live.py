"""File round trips, streams and models over the test tables."""

import uuid

from pyspark.sql import functions as F

from touchline import constants as C
from touchline.catalog import tables as T
from touchline.catalog.analysis import _DEG, _POLICY, _SC, _degraded, _scored_rows
from touchline.catalog.registry import R, query, r6
from touchline.operators import editorial, features, labels, models, windows
from touchline.session import stage, stage_dir
from touchline.sources import epts, events_csv, sinks, tracking_csv
from touchline.sources import star_tables as S
from touchline.sources.text_order import match_from_path
from touchline.streaming import live
from touchline.streaming.run import route_messages, run_to_end, with_metrics

# --- round trips through the file formats -----------------------------------------------


def _path(spark) -> str:
    return f"{stage_dir(spark)}/files-{uuid.uuid4().hex}"


_MATCH = r"match_id=(\d+)"


def _written_match(spark, d):
    base = _path(spark)
    f = stage(S.frames(spark, d, source=True))
    for team in C.TEAMS:
        tracking_csv.write_team(f, f"{base}/{team}", team, [f"{t}_{s}" for t, s, _, _ in S.SLOTS if t == team], made=S.PLAYERS, compression="gzip")
    return tracking_csv.read_match(spark, f"{base}/home", f"{base}/away", match_from_path(_MATCH))


def _id():
    return F.col("match_id").cast("bigint").alias("match_id")


def _cm(c):
    # five decimals of the unit square are about a millimetre: centimetres survive the trip
    return F.round(c, 2) + F.lit(0.0)


@query("src_tracking_csv", """[frames pos] SELECT p.match_id, p.period, p.frame, p.player_id, round(p.x,2)+0 AS x, round(p.y,2)+0 AS y, round(f.ball_x,2)+0 AS bx, round(f.ball_y,2)+0 AS by_, f.row_no, f.period_row
    FROM pos p JOIN frames f USING (match_id, period, frame)""")
def src_tracking_csv(spark, d):
    f = _written_match(spark, d).select("match_id", "period", "frame", "row_no", "period_row", "ball_x", "ball_y", F.explode_outer("players").alias("p")).filter("p IS NOT NULL")
    return f.select(_id(), "period", "frame", "row_no", "period_row", F.col("p.player_id").alias("player_id"), _cm("p.x").alias("x"), _cm("p.y").alias("y"),
                    _cm("ball_x").alias("bx"), _cm("ball_y").alias("by_"))


@query("src_match_pair", "[pos] SELECT match_id, period, count(*) AS n, count(x) AS n_present FROM pos GROUP BY 1, 2")
def src_match_pair(spark, d):
    # the outer form, as in unpack_players: no filter is inferred that takes every line apart again
    p = _written_match(spark, d).select(_id(), "period", F.explode_outer("players").alias("p")).filter("p IS NOT NULL")
    return p.groupBy("match_id", "period").agg(F.count(F.lit(1)).alias("n"), F.count("p.x").alias("n_present"))


@query("set_union_teams", "[pos] SELECT match_id, team, count(*) AS n FROM pos GROUP BY 1, 2")
def set_union_teams(spark, d):
    p = features.unpack_players(_written_match(spark, d))
    return p.groupBy(_id(), "team").agg(F.count(F.lit(1)).alias("n"))


@query("src_events_csv", """[ev] SELECT match_id, team, type, period, start_frame, end_frame, round(start_x,2)+0 AS start_x, round(end_y,2)+0 AS end_y FROM ev""")
def src_events_csv(spark, d):
    path = _path(spark)
    events_csv.write_events(S.events(spark, d), path)
    e = events_csv.read_events(spark, path, match_from_path(_MATCH))
    return e.select(_id(), "team", "type", "period", "start_frame", "end_frame", _cm("start_x").alias("start_x"), _cm("end_y").alias("end_y"))


_METADATA = """<Metadata><GlobalConfig><FrameRate>25</FrameRate><ProviderParameters>
<ProviderParameter><Name>first_half_start</Name><Value>1</Value></ProviderParameter><ProviderParameter><Name>first_half_end</Name><Value>{h}</Value></ProviderParameter>
<ProviderParameter><Name>second_half_start</Name><Value>{h1}</Value></ProviderParameter><ProviderParameter><Name>second_half_end</Name><Value>{n}</Value></ProviderParameter></ProviderParameters></GlobalConfig>
<Teams><Team id="T0"/><Team id="T1"/></Teams><Players>{players}</Players><PlayerChannels>{channels}</PlayerChannels>
<DataFormatSpecification startFrame="1" endFrame="{h}">{refs}</DataFormatSpecification><DataFormatSpecification startFrame="{h1}" endFrame="{n}">{back}</DataFormatSpecification></Metadata>"""


def _epts_metadata(spark, d):
    """Metadata as one XML file per match (there are S.MATCHES of them): the column order changes at half time."""
    ids = [f"{t}_{s}" for t, s, _, _ in S.SLOTS]
    ref = lambda order: "".join(f'<PlayerChannelRef playerChannelId="{i}{a}"/>' for i in order for a in "xy")
    squad = "".join(f'<Player id="{i}" teamId="{"T0" if i[0] == "h" else "T1"}"><ShirtNumber>{i[5:]}</ShirtNumber></Player>' for i in ids)
    channels = "".join(f'<PlayerChannel id="{i}{a}" playerId="{i}"/>' for i in ids for a in "xy")
    files = [
        (r["match_id"], _METADATA.format(h=r["n"] // 2, h1=r["n"] // 2 + 1, n=r["n"], refs=ref(ids), back=ref(ids[::-1]), players=squad, channels=channels).replace("\n", ""))
        for r in S.match_sizes(spark, d).collect()
    ]
    path = _path(spark)
    spark.createDataFrame(files, "match_id bigint, value string").write.partitionBy("match_id").text(path)
    return epts.read_metadata(spark, path, match_from_path(_MATCH))


@query("src_tracking_epts", """[pos] SELECT match_id, period, frame, player_id, round(x,2)+0 AS x, round(y,2)+0 AS y FROM pos""")
def src_tracking_epts(spark, d):
    meta = _epts_metadata(spark, d)
    cell = lambda x, y: f"concat(coalesce(format_string('%.5f', {x} / 105D + 0.5D), 'NaN'), ',', coalesce(format_string('%.5f', 0.5D - {y} / 68D), 'NaN'))"
    players = f"transform(CASE WHEN period = 1 THEN players ELSE reverse(players) END, p -> {cell('p.x', 'p.y')})"
    path = _path(spark)
    lines = S.frames(spark, d, True).selectExpr("match_id", f"concat(frame, ':', array_join({players}, ';'), ':', {cell('ball_x', 'ball_y')}) AS value")
    lines.write.partitionBy("match_id").text(path)
    f = features.unpack_players(epts.read_tracking(spark, path, meta, match_from_path(_MATCH)))
    return f.select(_id(), "period", "frame", "player_id", _cm("x").alias("x"), _cm("y").alias("y"))


@query("join_interval_layout", "[frames] SELECT match_id, period, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM frames GROUP BY 1, 2")
def join_interval_layout(spark, d):
    return src_tracking_epts(spark, d).select("match_id", "period", "frame").distinct().groupBy("match_id", "period").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query("src_events_json", """[ev] SELECT match_id, event_seq, team, type, period, start_frame, end_frame, round(start_x,2)+0 AS start_x, round(end_y,2)+0 AS end_y FROM ev""")
def src_events_json(spark, d):
    meta = _epts_metadata(spark, d)
    e = S.events(spark, d).selectExpr("match_id", "floor(event_seq / 4096) AS doc", """struct(
        struct(CASE team WHEN 'home' THEN 'T0' ELSE 'T1' END AS id) AS team, struct(upper(replace(type, '_', ' ')) AS name) AS type, array(struct(cast(event_seq AS string) AS name)) AS subtypes, period,
        struct(start_frame AS frame, start_time_s AS time, start_x / 105D + 0.5D AS x, 0.5D - start_y / 68D AS y) AS start,
        struct(end_frame AS frame, end_time_s AS time, end_x / 105D + 0.5D AS x, 0.5D - end_y / 68D AS y) AS `end`) AS e""")
    path = _path(spark)
    # documents of at most 4096 events each, one per file as the format has it
    docs = e.groupBy("match_id", "doc").agg(F.collect_list("e").alias("data")).select("match_id", "doc", F.to_json(F.struct("data")).alias("value"))
    docs.write.partitionBy("match_id", "doc").text(path)
    r = epts.read_events(spark, f"{path}/*/*", meta, match_from_path(_MATCH))
    return r.select(_id(), F.col("subtype").cast("bigint").alias("event_seq"), "team", "type", "period", "start_frame", "end_frame", _cm("start_x").alias("start_x"), _cm("end_y").alias("end_y"))


@query("sink_frame_json", f"""[frames pos] SELECT f.match_id, f.frame, count(p.x) AS present, count(*) AS slots, f.ball_x IS NOT NULL AS has_ball, {R('round(max(p.x),2)')} AS max_x
    FROM frames f JOIN pos p USING (match_id, period, frame) GROUP BY ALL""")
def sink_frame_json(spark, d):
    f = S.frames(spark, d, True).selectExpr("*", "cast(null AS double) AS probability", "false AS window_valid", "'home' AS attacking_team", "1 AS sign", "cast(null AS string) AS reason")
    j = sinks.as_json(sinks.frame_payload(f), "payload")
    parsed = j.select("match_id", F.from_json("value", "frame bigint, home array<array<double>>, away array<array<double>>, ball array<double>").alias("v"))
    return parsed.selectExpr("match_id", "v.frame AS frame", "concat(v.home, v.away) AS a", "v.ball IS NOT NULL AS has_ball").select(
        "match_id", "frame", F.expr("cast(size(filter(a, p -> p IS NOT NULL)) AS bigint)").alias("present"), F.size("a").cast("bigint").alias("slots"), "has_ball",
        r6(F.expr("array_max(transform(a, p -> p[0]))")).alias("max_x"))


@query("sink_insight_json", f"[w] AND RECURSIVE_ {_SC} SELECT match_id, kind, time_s AS emitted_at_s, probability FROM oc WHERE reason IS NULL")
def sink_insight_json(spark, d):
    j = sinks.as_json(sinks.insight_record(editorial.editorial_review(_scored_rows(spark, d), 0.4)), "insight")
    return j.select("match_id", F.from_json("value", "kind string, emitted_at_s double, probability double").alias("v")).select("match_id", "v.*")


@query("src_prepared", "[smp] SELECT match_id, count(*) AS n, count(*) FILTER (hit) AS positives FROM smp WHERE match_id IN (1, 3) GROUP BY 1")
def src_prepared(spark, d):
    from touchline.sources import prepared

    path = _path(spark)
    T.samples(spark, d)[0].write.partitionBy("match_id").parquet(path)
    s = prepared.load_prepared(spark, path, [1, 3])
    return s.groupBy(F.col("match_id").cast("bigint").alias("match_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


# --- streams ----------------------------------------------------------------------------

#: event times begin here: a watermark begins at 0
_START_MS = 10_000_000
_FRAME_MS = 40


def _arrivals(spark, d, carry=()):
    """Frames of the degraded feed; arrival time is the place in the feed, so late and repeated frames keep theirs."""
    place = F.col("row_no") - 1 + F.when(F.col("was_reordered"), C.DEGRADE_PROFILES["degraded"]["reorder_by"]).otherwise(0)
    at_ms = (F.lit(_START_MS) + place * _FRAME_MS).cast("bigint").alias("at_ms")
    return _degraded(spark, d).select("match_id", at_ms, F.lit(None).cast("string").alias("control"), "sequence", "period", "frame", F.col("ball_x").isNotNull().alias("has_ball"), *carry)


def _shuffled(rows):
    """In files that each hold rows of every time: no order of files is the order of the feed."""
    return rows.repartition(F.xxhash64("at_ms"))


_NEWEST = """mx AS (SELECT ds.match_id, sequence, ds.frame, max(ds.frame) OVER (PARTITION BY ds.match_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, f.period, f.ball_x IS NOT NULL AS has
      FROM ds JOIN frames f ON f.match_id=ds.match_id AND f.frame=ds.frame),
    ok AS (SELECT *, coalesce(frame>newest,true) AS accepted FROM mx),
    v AS (SELECT match_id, sequence, frame, has, count(*) OVER x AS n, avg(has::INT) OVER x AS r FROM ok WHERE accepted WINDOW x AS (PARTITION BY match_id, period ORDER BY sequence ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)),
    vr AS (SELECT *, CASE WHEN n<128 THEN 'insufficient_frames' WHEN r<0.8::DOUBLE OR NOT has THEN 'invalid_window' END AS invalid_reason FROM v)"""


@query("st_ingest", f"[frames] AND {_DEG}, {_NEWEST} SELECT ok.match_id, ok.sequence, accepted, CASE WHEN accepted THEN coalesce(ok.frame-newest-1,0) ELSE 0 END AS missing, CASE WHEN NOT accepted THEN 'out_of_order' END AS rejection, invalid_reason FROM ok LEFT JOIN vr USING (match_id, sequence)")
def st_ingest(spark, d):
    out = run_to_end(_shuffled(_arrivals(spark, d)), live.ingest_stream)
    return out.select("match_id", "sequence", "accepted", "missing", "rejection", "invalid_reason")


@query("st_window", f"[frames] AND {_DEG}, {_NEWEST} SELECT match_id, frame, invalid_reason IS NULL AS window_valid, invalid_reason FROM vr")
def st_window(spark, d):
    out = run_to_end(_shuffled(_arrivals(spark, d)), live.ingest_stream)
    return out.filter("accepted").select("match_id", "frame", "window_valid", "invalid_reason")


_EVENT_COLUMNS = ("team", "type", "end_frame")


def _events(spark, d):
    """Events arrive just before the first frame that they are known at."""
    at_ms = (F.lit(_START_MS - _FRAME_MS // 2) + (F.col("start_frame") - 1) * _FRAME_MS).cast("bigint").alias("at_ms")
    return S.events(spark, d).select("match_id", at_ms, F.lit(0).alias("kind"), F.col("start_frame").alias("frame"), F.col("event_seq").alias("seq"), *_EVENT_COLUMNS)


def _with_signs(spark, frames):
    return frames.join(features.signs(S.orientation(spark)), ["match_id", "period"]).withColumn("kind", F.lit(1)).withColumn("seq", F.lit(0).cast("bigint"))


_ENTRIES = """be AS (SELECT *, inside AND NOT lag(inside,1,false) OVER (PARTITION BY match_id, period ORDER BY frame) AS entry FROM seen),
    hs AS (SELECT *, sum(entry::INT) OVER (PARTITION BY match_id, period ORDER BY round(time_s*1000000)::BIGINT RANGE BETWEEN 120000000 PRECEDING AND CURRENT ROW)::BIGINT - entry::INT AS entries,
      least(120::DOUBLE, coalesce(time_s - max(CASE WHEN entry THEN time_s END) OVER (PARTITION BY match_id, period ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 120::DOUBLE)) AS since FROM be)"""


@query("st_context", f"""[ins] AND seen AS (SELECT * FROM ins), {_ENTRIES} SELECT match_id, frame, possession_team, {R('possession_duration_s')} AS possession_duration_s, possession_event_count, is_dead_ball, event_in_flight, recent_pass_count,
    entries AS recent_box_entry_count, {R('since')} AS time_since_last_box_entry, inside AS in_box FROM hs""")
def st_context(spark, d):
    at_ms = (F.lit(_START_MS) + (F.col("frame") - 1) * _FRAME_MS).cast("bigint").alias("at_ms")
    frames = _with_signs(spark, S.frames(spark, d)).select("match_id", at_ms, "kind", "frame", "seq", "period", "time_s", "ball_x", "ball_y", "home_sign", "away_sign")
    timeline = frames.unionByName(_events(spark, d), allowMissingColumns=True).withColumn("control", F.lit(None).cast("string"))
    out = run_to_end(_shuffled(timeline), live.context_stream)
    return out.select("match_id", "frame", "possession_team", r6("possession_duration_s").alias("possession_duration_s"), "possession_event_count", "is_dead_ball", "event_in_flight", "recent_pass_count",
                      "recent_box_entry_count", r6("time_since_last_box_entry").alias("time_since_last_box_entry"), "in_box")


def _scored_feed(spark, d):
    at_ms = (F.lit(_START_MS) + F.col("row_no") * _FRAME_MS).cast("bigint")
    return _shuffled(_scored_rows(spark, d).withColumn("at_ms", at_ms).withColumn("control", F.lit(None).cast("string")))


@query("st_editorial", f"[w] AND RECURSIVE_ {_SC} SELECT match_id, row_no, kind, reason, reason IS NULL AS emitted FROM oc")
def st_editorial(spark, d):
    return run_to_end(_scored_feed(spark, d), lambda s: live.editorial_stream(s, 0.4)).select("match_id", "row_no", "kind", "reason", "emitted")


_ROLLED = """rl AS (SELECT match_id, (row_no-1)//25 AS interval, reason, count(*) AS n FROM oc GROUP BY 1,2,3),
    rolled AS (SELECT match_id, interval, sum(n)::BIGINT AS frames, coalesce(sum(n) FILTER (reason IS NULL),0)::BIGINT AS emitted, coalesce(string_agg(reason||'='||n, ',' ORDER BY reason) FILTER (reason IS NOT NULL),'') AS counts FROM rl GROUP BY 1,2 HAVING sum(n)=25)"""


@query("st_rollup", f"[w] AND RECURSIVE_ {_SC}, {_ROLLED} SELECT * FROM rolled")
def st_rollup(spark, d):
    """Policy and rollup as two operators of one stream."""
    return run_to_end(_scored_feed(spark, d), lambda s: live.rollup_stream(live.editorial_stream(s, 0.4)), operators=2)


#: frames accepted, windows and context as in the queries above; a frame's score is where the ball is; match 3 has no model
_ENGINE = f"""{_DEG}, {_NEWEST}, seen AS (SELECT i.*, vr.sequence, vr.invalid_reason FROM ins i JOIN vr ON vr.match_id=i.match_id AND vr.frame=i.frame), {_ENTRIES},
    sc AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS row_no, possession_team AS team, coalesce((ball_x+52.5::DOUBLE)/105::DOUBLE,0) AS probability FROM hs WHERE possession_team IS NOT NULL),
    s1 AS (SELECT *, CASE WHEN invalid_reason IS NOT NULL THEN invalid_reason WHEN match_id=3 THEN 'model_unavailable' WHEN is_dead_ball THEN 'dead_ball' WHEN inside THEN 'already_in_box' WHEN probability<0.4::DOUBLE THEN 'low_confidence' END AS r0,
      CASE WHEN entries>=2 AND possession_duration_s>=8 THEN 'sustained_pressure' WHEN probability>=0.4::DOUBLE+0.6::DOUBLE*0.45::DOUBLE THEN 'elevated_entry_chance' ELSE 'building_threat' END AS kd FROM sc),
    {_POLICY}"""


def _timeline(spark, d, replays: int):
    """The feed played ``replays`` times, each time but the first after a reset row; sequence numbers go on."""
    score = F.coalesce((F.col("ball_x") + 52.5) / 105.0, F.lit(0.0)).alias("probability")
    frames = _with_signs(spark, _arrivals(spark, d, ("time_s", "ball_x", "ball_y", score)))
    once = stage(frames.unionByName(_events(spark, d).withColumn("control", F.lit(None).cast("string")).withColumn("sequence", F.lit(-1).cast("bigint")), allowMissingColumns=True))
    ends = once.groupBy("match_id").agg(F.max("sequence").alias("n"))
    span = once.agg(F.max("at_ms")).first()[0] or 0
    length = span - _START_MS + 10_000
    again = once.join(ends, "match_id").withColumn("replay", F.explode(F.sequence(F.lit(0), F.lit(replays - 1))))
    rows = again.withColumn("at_ms", F.col("at_ms") + F.col("replay") * length).withColumn("sequence", F.col("sequence") + F.col("replay") * (F.col("n") + 2))
    resets = ends.withColumn("replay", F.explode(F.sequence(F.lit(1), F.lit(replays - 1)))).select(
        "match_id", (F.lit(_START_MS - 5_000) + F.col("replay") * length).cast("bigint").alias("at_ms"), F.lit("reset").alias("control"), (F.col("replay") * (F.col("n") + 2) - 1).alias("sequence"),
        F.lit(0).cast("bigint").alias("frame"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("seq"))
    return rows.drop("n", "replay").unionByName(resets, allowMissingColumns=True)


_CARRIED = "period int, time_s double, ball_x double, ball_y double, home_sign int, away_sign int, kind int, seq bigint, team string, type string, end_frame bigint, probability double"


def engine(timeline, models):
    """Intake, context, model table and policy as one stream of three stateful operators."""
    taken = live.ingest_stream(timeline, _CARRIED)
    taken = taken.filter(F.col("accepted") | F.col("control").isNotNull())
    context = live.context_stream(taken, "sequence bigint, time_s double, probability double, window_valid boolean, invalid_reason string")
    scored = live.with_models(context, models).withColumn("row_no", F.col("sequence")).withColumn("is_dead_ball", F.col("is_dead_ball").cast("double")).withColumn("ball_in_box", F.col("in_box").cast("double"))
    return live.editorial_stream(scored, 0.4)


def _models(spark):
    return spark.createDataFrame([(m, f"model-{m}") for m in range(3)], "match_id bigint, model string")


@query("st_engine", f"""[ins frames] AND RECURSIVE_ {_ENGINE}, last AS (SELECT match_id, max(sequence) AS n FROM ds GROUP BY 1)
    SELECT oc.match_id, sequence + replay*(n+2) AS sequence, kind, oc.reason, oc.reason IS NULL AS emitted FROM oc JOIN sc USING (match_id, row_no) JOIN last USING (match_id), range(2) t(replay)""")
def st_engine(spark, d):
    """A late and incomplete feed, played twice with a reset between: both give what the batch gives once."""
    out = run_to_end(_shuffled(_timeline(spark, d, 2)), lambda s: engine(s, _models(spark)), operators=3)
    return out.select("match_id", F.col("row_no").alias("sequence"), "kind", "reason", "emitted")


@query("st_metrics", f"""[frames] AND {_DEG}, {_NEWEST} SELECT count(*) AS frames, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS out_of_order,
    sum(CASE WHEN accepted THEN coalesce(ok.frame-newest-1,0) ELSE 0 END)::BIGINT AS missing_frames, count(*) FILTER (invalid_reason IS NOT NULL) AS invalid_windows FROM ok LEFT JOIN vr USING (match_id, sequence)""")
def st_metrics(spark, d):
    """Sums of the counters that the listener kept, a row a micro-batch."""
    feed = _shuffled(_arrivals(spark, d))
    table = with_metrics(spark, "intake", lambda: run_to_end(feed, lambda s: live.observed(live.ingest_stream(s), "intake")))
    names = ("frames", "accepted", "out_of_order", "missing_frames", "invalid_windows")
    return table.read(", ".join(f"{n} bigint" for n in names)).agg(*[F.sum(n).alias(n) for n in names])


@query("st_messages", f"""[w] AND RECURSIVE_ {_SC}, {_ROLLED} SELECT 'insight' AS type, match_id, count(*) AS n, min(row_no) AS first_no, max(row_no) AS last_no FROM oc WHERE reason IS NULL GROUP BY 2
    UNION ALL SELECT 'suppressed', match_id, count(*), min(row_no), max(row_no) FROM oc WHERE reason IS NOT NULL GROUP BY 2""")
def st_messages(spark, d):
    """Outcomes as messages, a table a type; every batch is written twice and is there once."""
    path = _path(spark)
    write = route_messages(path, ("insight", "suppressed"))

    def twice(batch, batch_id):
        typed = batch.filter("control IS NULL").withColumn("type", F.when(F.col("emitted"), "insight").otherwise("suppressed"))
        write(typed, batch_id)
        write(typed, batch_id)

    run_to_end(_scored_feed(spark, d), lambda s: live.editorial_stream(s, 0.4), sink=twice)
    count = lambda kind: spark.read.parquet(f"{path}/{kind}").groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_no"), F.max("row_no").alias("last_no")).select(
        F.lit(kind).alias("type"), "match_id", "n", "first_no", "last_no")
    return count("insight").unionByName(count("suppressed"))


# --- models -----------------------------------------------------------------------------


@query("model_logistic")
def model_logistic(spark, d):
    f, s, _ = T.window_features(spark, d)
    summary = stage(windows.measured_windows(f, s, windows.summary_of, ", ".join(f"{c} double" for c in models.summary_columns()), width=features.BLOCK))
    fitted = models.fit_logistic(summary.filter("match_id <> 0"))
    return models.score(fitted, summary.filter("match_id = 0"), "baseline-logistic").select("match_id", "row_no", "label", "probability")
