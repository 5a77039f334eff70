"""Geometry, events, joins, possession, features, labels, windows."""

from pyspark.sql import functions as F

from touchline import constants as C
from touchline import schema
from touchline.catalog import tables as T
from touchline.catalog.registry import R, query, r6
from touchline.functions import events as ev
from touchline.functions import geometry as geo
from touchline.functions import scoring, text
from touchline.operators import features, labels, possession, windows
from touchline.session import stage
from touchline.sources import star_tables as S

# --- flagship ---------------------------------------------------------------------------


@query("entries_by_team", f"""[ent] SELECT match_id, team, count(*) AS n_entries, {R('min(time_s)')} AS first_entry_s,
    {R('max(time_s)')} AS last_entry_s FROM ent GROUP BY 1, 2""")
def entries_by_team(spark, d):
    return T.entries(spark, d).groupBy("match_id", "team").agg(
        F.count(F.lit(1)).alias("n_entries"), r6(F.min("time_s")).alias("first_entry_s"), r6(F.max("time_s")).alias("last_entry_s"))


# --- scalar functions -------------------------------------------------------------------

_GEO = "SELECT match_id, frame, "


@query("geo_to_canonical", f"""SELECT l_orderkey, l_linenumber, {R('(l_discount*10-0.5::DOUBLE)*105::DOUBLE')} AS x,
    {R('(0.5::DOUBLE-l_tax*10)*68::DOUBLE')} AS y FROM lineitem""")
def geo_to_canonical(spark, d):
    return S.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(geo.to_canonical_x(F.col("l_discount") * 10)).alias("x"),
        r6(geo.to_canonical_y(F.col("l_tax") * 10)).alias("y"))


@query("geo_to_unit", f"[frames] {_GEO}{R('ball_x/105::DOUBLE+0.5::DOUBLE')} AS u, {R('0.5::DOUBLE-ball_y/68::DOUBLE')} AS v FROM frames")
def geo_to_unit(spark, d):
    return S.frames(spark, d).select(
        "match_id", "frame", r6(geo.to_unit_x(F.col("ball_x"))).alias("u"), r6(geo.to_unit_y(F.col("ball_y"))).alias("v"))


@query("geo_rotate", f"[hyp] SELECT match_id, frame, att AS team, {R('bx')} AS x, {R('by_')} AS y FROM hyp")
def geo_rotate(spark, d):
    f = S.frames(spark, d).join(S.orientation(spark), ["match_id", "period"])
    return f.select("match_id", "frame", "team", r6(geo.rotate(F.col("ball_x"), F.col("sign"))).alias("x"),
                    r6(geo.rotate(F.col("ball_y"), F.col("sign"))).alias("y"))


@query("geo_in_box", """[frames] SELECT match_id, period, count(*) AS n, count(*) FILTER (coalesce(ball_x BETWEEN 36::DOUBLE AND 52.5::DOUBLE
    AND abs(ball_y)<=20.16::DOUBLE, false)) AS n_in_box FROM frames GROUP BY 1, 2""")
def geo_in_box(spark, d):
    return S.frames(spark, d).groupBy("match_id", "period").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(geo.in_box(F.col("ball_x"), F.col("ball_y"))).alias("n_in_box"))


@query("geo_on_pitch", """[frames] SELECT match_id, frame, coalesce(abs(ball_x*1.2::DOUBLE)<=57.5::DOUBLE AND abs(ball_y)<=39::DOUBLE, false) AS on_pitch FROM frames""")
def geo_on_pitch(spark, d):
    return S.frames(spark, d).select("match_id", "frame", geo.on_pitch(F.col("ball_x") * 1.2, F.col("ball_y"), 5.0).alias("on_pitch"))


@query("geo_goal_distance", f"[frames] {_GEO}{R('sqrt((ball_x-52.5::DOUBLE)*(ball_x-52.5::DOUBLE)+ball_y*ball_y)')} AS m FROM frames")
def geo_goal_distance(spark, d):
    return S.frames(spark, d).select("match_id", "frame", r6(geo.goal_distance(F.col("ball_x"), F.col("ball_y"))).alias("m"))


@query("geo_goal_angle", f"""[frames] {_GEO}{R('CASE WHEN 52.5::DOUBLE-ball_x > 0 THEN abs(atan2(3.66::DOUBLE-ball_y, 52.5::DOUBLE-ball_x)-atan2(-3.66::DOUBLE-ball_y, 52.5::DOUBLE-ball_x)) ELSE 0 END')} AS rad FROM frames""")
def geo_goal_angle(spark, d):
    return S.frames(spark, d).select("match_id", "frame", r6(geo.goal_angle(F.col("ball_x"), F.col("ball_y"))).alias("rad"))


@query("dir_sign_flip", """SELECT o_orderkey, CASE WHEN o_totalprice-200000 >= 0 THEN 1 ELSE -1 END AS sign, CASE WHEN o_totalprice-200000 >= 0 THEN -1 ELSE 1 END AS flipped,
    CASE WHEN o_totalprice-200000 >= 0 THEN '+x' ELSE '-x' END AS label FROM orders""")
def dir_sign_flip(spark, d):
    s = ev.sign_of(F.col("o_totalprice") - 200000)
    return S.read(spark, d, "orders").select("o_orderkey", s.alias("sign"), ev.flip(s).alias("flipped"), ev.sign_label(s).alias("label"))


@query("team_opponent", """[ev] SELECT event_seq, team, CASE team WHEN 'home' THEN 'away' ELSE 'home' END AS opponent, CASE team WHEN 'home' THEN 0 ELSE 1 END AS code FROM ev""")
def team_opponent(spark, d):
    t = F.col("team")
    return S.events(spark, d).select("event_seq", "team", ev.opponent(t).alias("opponent"), ev.team_code(t).alias("code"))


_RAW = """CASE event_type WHEN 'click' THEN ' pass' WHEN 'view' THEN 'Carry ' WHEN 'purchase' THEN 'BALL LOST' WHEN 'signup' THEN 'set piece' ELSE event_type END"""


@query("ev_type_map", """SELECT event_id, CASE event_type WHEN 'click' THEN 'pass' WHEN 'view' THEN 'carry' WHEN 'purchase' THEN 'ball_lost'
    WHEN 'signup' THEN 'set_piece' ELSE 'other' END AS type FROM events""")
def ev_type_map(spark, d):
    return S.read(spark, d, "events").select("event_id", ev.event_type(F.expr(_RAW)).alias("type"))


@query("ev_flags", "[ev] SELECT event_seq, type, dead AS is_dead_ball, on_ball AS is_on_ball FROM ev")
def ev_flags(spark, d):
    k = F.col("type")
    return S.events(spark, d).select("event_seq", "type", ev.is_dead_ball(k).alias("is_dead_ball"), ev.is_on_ball(k).alias("is_on_ball"))


@query("ev_redact", f"""[ev] SELECT event_seq, end_frame <= start_frame+20 AS resolved, CASE WHEN end_frame <= start_frame+20 THEN end_frame END AS end_frame,
    CASE WHEN end_frame <= start_frame+20 THEN {R('end_x')} END AS end_x FROM ev""")
def ev_redact(spark, d):
    now, end = F.col("start_frame") + 20, F.col("end_frame")
    return S.events(spark, d).select("event_seq", (end <= now).alias("resolved"), ev.redact(now, end, end).alias("end_frame"),
                                     ev.redact(now, end, r6("end_x")).alias("end_x"))


@query("ev_end_defaults", """SELECT event_id, greatest(event_id % 50, CASE WHEN user_id-20 > 0 THEN user_id-20 ELSE event_id % 50 END) AS end_frame FROM events""")
def ev_end_defaults(spark, d):
    return S.read(spark, d, "events").select("event_id", ev.end_not_before(F.col("event_id") % 50, F.col("user_id") - 20).alias("end_frame"))


@query("num_try_float", f"""SELECT event_id, {R("CASE WHEN event_id % 7 IN (0,1,2) THEN NULL ELSE value END")} AS v FROM events""")
def num_try_float(spark, d):
    raw = (F.when(F.col("event_id") % 7 == 0, " ").when(F.col("event_id") % 7 == 1, "NaN").when(F.col("event_id") % 7 == 2, "1.2x")
           .otherwise(F.concat(F.lit(" "), F.col("value").cast("string"))))
    return S.read(spark, d, "events").select("event_id", r6(ev.try_number(raw)).alias("v"))


@query("num_nan_fill", f"[frames] {_GEO}{R('coalesce(ball_x, 0)')} AS x FROM frames")
def num_nan_fill(spark, d):
    return S.frames(spark, d).select("match_id", "frame", r6(F.coalesce("ball_x", F.lit(0.0))).alias("x"))


@query("margin", f"SELECT l_orderkey, l_linenumber, {R('least(1::DOUBLE, abs(l_quantity-25)/12.5::DOUBLE)')} AS margin FROM lineitem")
def margin(spark, d):
    return S.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(ev.margin(F.col("l_quantity") - 25, 12.5)).alias("margin"))


@query("insight_kind", """[w] SELECT match_id, row_no, CASE WHEN row_no % 5 >= 2 AND row_no % 17 >= 8 THEN 'sustained_pressure'
    WHEN probability >= 0.8::DOUBLE+(1-0.8::DOUBLE)*0.45::DOUBLE THEN 'elevated_entry_chance' ELSE 'building_threat' END AS kind FROM w""")
def insight_kind(spark, d):
    k = scoring.insight_kind(F.col("probability"), F.col("row_no") % 5, F.col("row_no") % 17, scoring.high_band(0.8))
    return S.windows(spark, d).select("match_id", "row_no", k.alias("kind"))


@query("insight_headline", """[w] SELECT match_id, row_no, CASE WHEN row_no % 5 >= 2 AND row_no % 17 >= 8 THEN 'Signs of sustained pressure building'
    WHEN probability >= 0.8::DOUBLE+(1-0.8::DOUBLE)*0.45::DOUBLE THEN 'Movement suggests an elevated chance of a penalty-area entry'
    ELSE 'Attacking threat is building' END AS headline FROM w""")
def insight_headline(spark, d):
    return insight_kind(spark, d).select("match_id", "row_no", text.headline(F.col("kind")).alias("headline"))


_FACT_COLS = {
    "attackers_ahead_of_ball": "row_no % 5", "nearest_defender_dist": "(row_no*7 % 200)::DOUBLE/10::DOUBLE",
    "recent_box_entry_count": "row_no*3 % 4", "defensive_line_x": "(row_no*11 % 400)::DOUBLE/10::DOUBLE-10::DOUBLE",
    "space_ahead_of_ball": "(row_no*13 % 500)::DOUBLE/10::DOUBLE", "possession_duration_s": "(row_no*17 % 600)::DOUBLE/10::DOUBLE",
}
_FACT_VALUES = ", ".join(f"{e} AS {n}" for n, e in _FACT_COLS.items())
_FACT_SQL = f"""[w] AND fv AS (SELECT match_id, row_no, {_FACT_VALUES} FROM w),
fc AS (SELECT match_id, row_no, unnest([
  CASE WHEN attackers_ahead_of_ball>=2 THEN {{'k':'attackers_ahead','o':0,'r':attackers_ahead_of_ball::DOUBLE,'t':attackers_ahead_of_ball||' attackers ahead of the ball'}} END,
  CASE WHEN nearest_defender_dist>=5 THEN {{'k':'nearest_defender','o':1,'r':nearest_defender_dist/5::DOUBLE,'t':'nearest defender '||round_even(nearest_defender_dist,0)::BIGINT||' m away'}} END,
  CASE WHEN recent_box_entry_count>=1 THEN {{'k':'recent_entries','o':2,'r':recent_box_entry_count+2::DOUBLE,'t':recent_box_entry_count||' recent penalty-area '||CASE WHEN recent_box_entry_count=1 THEN 'entry' ELSE 'entries' END}} END,
  CASE WHEN defensive_line_x>5 THEN {{'k':'high_line','o':3,'r':defensive_line_x/10::DOUBLE,'t':'defensive line '||round_even(defensive_line_x,0)::BIGINT||' m beyond halfway'}} END,
  CASE WHEN space_ahead_of_ball>=12 THEN {{'k':'space_ahead','o':4,'r':space_ahead_of_ball/12::DOUBLE,'t':round_even(space_ahead_of_ball,0)::BIGINT||' m of space ahead of the ball'}} END,
  CASE WHEN possession_duration_s>=12 THEN {{'k':'possession','o':5,'r':possession_duration_s/12::DOUBLE,'t':round_even(possession_duration_s,0)::BIGINT||' s of unbroken possession'}} END]) AS f FROM fv),
fr AS (SELECT *, row_number() OVER (PARTITION BY match_id, row_no ORDER BY f.r DESC, f.o) AS i FROM fc WHERE f IS NOT NULL),
ft AS (SELECT match_id, row_no, string_agg(f.k, '|' ORDER BY i) AS keys, string_agg(f.t, '; ' ORDER BY i) AS texts,
  list(f.t ORDER BY i) AS l FROM fr WHERE i <= 3 GROUP BY 1, 2)
"""


def _facts(spark, d):
    w = S.windows(spark, d)
    e = lambda s: s.replace("::DOUBLE", "D").replace(")D", ")")
    return w.select("match_id", "row_no", *[F.expr(e(x)).alias(n) for n, x in _FACT_COLS.items()]).withColumn("facts", text.facts())


@query("insight_facts", _FACT_SQL + "SELECT w.match_id, w.row_no, coalesce(keys,'') AS keys, coalesce(texts,'') AS texts FROM w LEFT JOIN ft USING (match_id, row_no)")
def insight_facts(spark, d):
    return _facts(spark, d).select("match_id", "row_no", F.array_join(F.transform("facts", lambda f: f["key"]), "|").alias("keys"),
                                   F.array_join(F.transform("facts", lambda f: f["text"]), "; ").alias("texts"))


@query("topk_facts", _FACT_SQL + "SELECT keys, count(*) AS n FROM ft GROUP BY 1")
def topk_facts(spark, d):
    keys = F.array_join(F.transform("facts", lambda f: f["key"]), "|")
    return _facts(spark, d).filter(F.size("facts") > 0).groupBy(keys.alias("keys")).agg(F.count(F.lit(1)).alias("n"))


@query("insight_detail", _FACT_SQL + """SELECT w.match_id, w.row_no, coalesce(upper(s[1])||lower(s[2:]), '') AS detail FROM w LEFT JOIN (
    SELECT match_id, row_no, CASE WHEN len(l)=1 THEN l[1] ELSE array_to_string(l[1:len(l)-1], ', ')||' and '||l[len(l)] END AS s FROM ft) x USING (match_id, row_no)""")
def insight_detail(spark, d):
    return _facts(spark, d).select("match_id", "row_no", text.detail(F.col("facts")).alias("detail"))


_HEDGE = " OR ".join(f"contains(lower(text), '{t}')" for t in C.HEDGE_TERMS)
_ASSERT = " OR ".join(f"contains(lower(text), '{t}')" for t in C.FORBIDDEN_PHRASES)


@query("text_hedged", f"SELECT doc_id, ({_HEDGE}) AND NOT ({_ASSERT}) AS hedged FROM documents")
def text_hedged(spark, d):
    return S.read(spark, d, "documents").select("doc_id", text.is_hedged(F.col("text")).alias("hedged"))


# --- possession -------------------------------------------------------------------------


@query("win_possession_runs", "[runs] SELECT match_id, event_seq, team, run_start, run_events FROM runs")
def win_possession_runs(spark, d):
    return possession.possession_runs(S.events(spark, d)).select("match_id", "event_seq", "team", "run_start", "run_events")


@query("join_asof_possession", f"""[ctx] SELECT match_id, frame, possession_team, {R('possession_duration_s')} AS possession_duration_s, possession_event_count FROM ctx""")
def join_asof_possession(spark, d):
    return T.context(spark, d).select("match_id", "frame", "possession_team", r6("possession_duration_s").alias("possession_duration_s"), "possession_event_count")


@query("join_asof_latest_event", "[ctx] SELECT match_id, frame, is_dead_ball, event_in_flight FROM ctx")
def join_asof_latest_event(spark, d):
    return T.context(spark, d).select("match_id", "frame", "is_dead_ball", "event_in_flight")


@query("win_dead_ball_mask", "[ctx] SELECT match_id, frame, in_stoppage FROM ctx")
def win_dead_ball_mask(spark, d):
    return T.context(spark, d).select("match_id", "frame", "in_stoppage")


@query("win_recent_passes", "[ctx] SELECT match_id, frame, recent_pass_count FROM ctx")
def win_recent_passes(spark, d):
    return T.context(spark, d).select("match_id", "frame", "recent_pass_count")


@query("join_interval_visible", """[frames ev] SELECT f.match_id, f.frame, count(*) AS n_visible, count(*) FILTER (e.end_frame <= f.frame) AS n_resolved,
    sum(e.event_seq)::BIGINT AS seq_sum FROM frames f JOIN ev e ON e.match_id = f.match_id AND e.start_frame BETWEEN f.frame-100 AND f.frame GROUP BY 1, 2""")
def join_interval_visible(spark, d):
    v = possession.visible_events(S.frames(spark, d), S.events(spark, d), 100)
    return v.groupBy("match_id", "frame").agg(F.count(F.lit(1)).alias("n_visible"), F.count_if("resolved").alias("n_resolved"), F.sum("event_seq").alias("seq_sum"))


@query("agg_type_counts", """[frames ev] SELECT f.match_id, f.frame, e.type, count(*) AS n_events FROM frames f JOIN ev e ON e.match_id = f.match_id
    AND e.start_frame BETWEEN f.frame-100 AND f.frame WHERE e.team = 'home' GROUP BY 1, 2, 3""")
def agg_type_counts(spark, d):
    return possession.recent_type_counts(S.frames(spark, d), S.events(spark, d), 100, "home")


@query("possession_context", f"""[ctx] SELECT match_id, period, possession_team, count(*) AS n, {R('sum(possession_duration_s)')} AS duration_s, sum(possession_event_count)::BIGINT AS run_events,
    count(*) FILTER (is_dead_ball) AS dead, count(*) FILTER (event_in_flight) AS in_flight, count(*) FILTER (in_stoppage) AS stopped, sum(recent_pass_count)::BIGINT AS passes
    FROM ctx GROUP BY 1, 2, 3""")
def possession_context(spark, d):
    return T.context(spark, d).groupBy("match_id", "period", "possession_team").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("possession_duration_s")).alias("duration_s"), F.sum("possession_event_count").alias("run_events"),
        F.count_if("is_dead_ball").alias("dead"), F.count_if("event_in_flight").alias("in_flight"),
        F.count_if("in_stoppage").alias("stopped"), F.sum("recent_pass_count").alias("passes"))


# --- joins and sequence operators on frames ---------------------------------------------


@query("join_orientation", "[frames ori] SELECT f.match_id, f.frame, o.team, o.sign FROM frames f JOIN ori o USING (match_id, period)")
def join_orientation(spark, d):
    return S.frames(spark, d).join(S.orientation(spark), ["match_id", "period"]).select("match_id", "frame", "team", "sign")


@query("join_two_hypotheses", "[hyp] SELECT match_id, period, att AS attacking_team, count(*) AS n, sum(sign)::BIGINT AS signs FROM hyp GROUP BY 1, 2, 3")
def join_two_hypotheses(spark, d):
    both = S.frames(spark, d).join(features.signs(S.orientation(spark)), ["match_id", "period"]).select(
        "match_id", "period", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"{t}_sign").alias("s")) for t in C.TEAMS])).alias("h"))
    return both.groupBy("match_id", "period", F.col("h.t").alias("attacking_team")).agg(F.count(F.lit(1)).alias("n"), F.sum("h.s").alias("signs"))


@query("join_player_ball", f"""[frames pos] SELECT p.match_id, p.frame, p.player_id, {R('sqrt((p.x-f.ball_x)*(p.x-f.ball_x)+(p.y-f.ball_y)*(p.y-f.ball_y))')} AS m
    FROM pos p JOIN frames f ON f.match_id = p.match_id AND f.frame = p.frame""")
def join_player_ball(spark, d):
    p = S.frames(spark, d, True).select("match_id", "frame", "ball_x", "ball_y", F.explode("players").alias("p"))
    return p.select("match_id", "frame", F.col("p.player_id").alias("player_id"),
                    r6(geo.distance(F.col("p.x"), F.col("p.y"), F.col("ball_x"), F.col("ball_y"))).alias("m"))


@query("win_velocity", f"[bv] SELECT match_id, frame, {R('vx')} AS vx, {R('vy')} AS vy FROM bv")
def win_velocity(spark, d):
    v = features.velocities(S.frames(spark, d))
    return v.select("match_id", "frame", r6("ball_vx").alias("vx"), r6("ball_vy").alias("vy"))


@query("win_rising_edge", f"[ent] SELECT match_id, frame, team, period, {R('time_s')} AS time_s FROM ent")
def win_rising_edge(spark, d):
    return T.entries(spark, d).select("match_id", "frame", "team", "period", r6("time_s").alias("time_s"))


@query("win_entry_history", f"""[hist] SELECT match_id, frame, max(entries) FILTER (att='home') AS home_entries, max(entries) FILTER (att='away') AS away_entries,
    {R("max(since) FILTER (att='home')")} AS home_since, {R("max(since) FILTER (att='away')")} AS away_since FROM hist GROUP BY 1, 2""")
def win_entry_history(spark, d):
    h = features.box_entry_history(S.frames(spark, d), S.orientation(spark))
    return h.select("match_id", "frame", "home_entries", "away_entries", r6("home_since").alias("home_since"), r6("away_since").alias("away_since"))


@query("win_possession_clusters", "[clu] SELECT match_id, cluster_id, count(*) AS n, min(frame) AS first_frame FROM clu GROUP BY 1, 2")
def win_possession_clusters(spark, d):
    c = labels.possession_clusters(stage(T.inside(spark, d)))
    return c.groupBy("match_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"))


@query("win_merge_episodes", f"[eps] SELECT match_id, {R('entry_time_s')} AS entry_time_s, team, period, n_entries FROM eps")
def win_merge_episodes(spark, d):
    return labels.merge_episodes(stage(T.entries(spark, d))).select("match_id", r6("entry_time_s").alias("entry_time_s"), "team", "period", "n_entries")


@query("win_stride_sample", "[frames] SELECT match_id, period, frame FROM frames WHERE period_row-1 >= 125 AND (period_row-1-125) % 12 = 0")
def win_stride_sample(spark, d):
    return labels.stride_rows(S.frames(spark, d)).select("match_id", "period", "frame")


@query("join_lookahead_label", "[smp] SELECT match_id, frame, hit::INT AS label, episode_id FROM smp")
def join_lookahead_label(spark, d):
    return T.samples(spark, d)[0].select("match_id", "frame", "label", "episode_id")


@query("build_labels", f"""[smp] SELECT match_id, period, frame, {R('time_s')} AS time_s, team, hit::INT AS label, episode_id, cluster_id FROM smp""")
def build_labels(spark, d):
    return T.samples(spark, d)[0].select("match_id", "period", "frame", r6("time_s").alias("time_s"), "team", "label", "episode_id", "cluster_id")


@query("agg_label_summary", """[smp] AND e AS (SELECT match_id, count(*) AS episodes, count(*) FILTER (team='home') AS episodes_home, count(*) FILTER (team='away') AS episodes_away FROM eps GROUP BY 1)
    SELECT s.match_id, s.samples, s.positives, s.positive_rate, s.clusters, e.episodes, e.episodes_home, e.episodes_away FROM (
    SELECT match_id, count(*) AS samples, count(*) FILTER (hit) AS positives, round(avg(hit::INT),5) AS positive_rate, count(DISTINCT cluster_id) AS clusters FROM smp GROUP BY 1) s JOIN e USING (match_id)""")
def agg_label_summary(spark, d):
    return labels.label_summary(*map(stage, T.samples(spark, d)))


# --- features ---------------------------------------------------------------------------

_BOX = "coalesce(x BETWEEN 36::DOUBLE AND 52.5::DOUBLE AND abs(y)<=20.16::DOUBLE,false)"
_BALL = {
    "ball_x": "coalesce(bx/52.5::DOUBLE,0)", "ball_y_abs": "coalesce(abs(by_)/34::DOUBLE,0)",
    "ball_speed": "coalesce(sqrt(vx*sign*vx*sign+vy*sign*vy*sign),0)", "ball_v_goalward": "coalesce(vx*sign,0)", "ball_v_lateral": "coalesce(abs(vy*sign),0)",
    "ball_dist_to_goal": "coalesce(sqrt((bx-52.5::DOUBLE)*(bx-52.5::DOUBLE)+by_*by_),0)",
    "ball_goal_angle": "coalesce(CASE WHEN 52.5::DOUBLE-bx>0 THEN abs(atan2(3.66::DOUBLE-by_,52.5::DOUBLE-bx)-atan2(-3.66::DOUBLE-by_,52.5::DOUBLE-bx)) END,0)",
    "ball_in_final_third": "coalesce(bx>=17.5::DOUBLE,false)::INT", "ball_in_box": "coalesce(bx BETWEEN 36::DOUBLE AND 52.5::DOUBLE AND abs(by_)<=20.16::DOUBLE,false)::INT",
}
_ATTACK = {
    "attackers_ahead_of_ball": "count(*) FILTER (attacks AND x>bx)", "attackers_in_box": f"count(*) FILTER (attacks AND {_BOX})",
    "attackers_in_final_third": "count(*) FILTER (attacks AND x>=17.5::DOUBLE)", "attackers_moving_goalward": "count(*) FILTER (attacks AND vx>0.5::DOUBLE)",
    "defenders_in_box": f"count(*) FILTER (NOT attacks AND {_BOX})", "defenders_goalside_of_ball": "count(*) FILTER (NOT attacks AND x>bx)",
    "defenders_within_10m_of_ball": "count(*) FILTER (NOT attacks AND d<=10::DOUBLE)",
}
_SHAPE = {
    "attack_centroid_x": "coalesce(avg(x) FILTER (attacks AND NOT gk),0)", "attack_width": "coalesce(stddev_pop(y) FILTER (attacks AND NOT gk),0)",
    "attack_depth": "coalesce(stddev_pop(x) FILTER (attacks AND NOT gk),0)", "attack_highest_x": "coalesce(max(x) FILTER (attacks AND NOT gk),0)",
    "attack_mean_v_goalward": "coalesce(avg(vx) FILTER (attacks),0)", "defence_centroid_x": "coalesce(avg(x) FILTER (NOT attacks AND NOT gk),0)",
    "defence_mean_v_goalward": "coalesce(avg(vx) FILTER (NOT attacks),0)",
    "defensive_compactness": "coalesce(avg(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))) FILTER (NOT attacks AND NOT gk),0)",
}
_NEAR = {
    "gk_dist_to_ball": "coalesce(max(d) FILTER (NOT attacks AND gk),105)",
    "gk_dist_to_goal": "coalesce(max(sqrt((x-52.5::DOUBLE)*(x-52.5::DOUBLE)+y*y)) FILTER (NOT attacks AND gk),105)",
    "nearest_defender_dist": "coalesce((list(d ORDER BY d) FILTER (NOT attacks AND d IS NOT NULL))[1],105)",
    "second_nearest_defender_dist": "coalesce((list(d ORDER BY d) FILTER (NOT attacks AND d IS NOT NULL))[2],105)",
    "nearest_attacker_support_dist": "coalesce((list(d ORDER BY d) FILTER (attacks AND d IS NOT NULL))[2],105)",
}
_KSMALL = {
    "defensive_line_x": "coalesce(list_avg((list(x ORDER BY x) FILTER (NOT attacks AND NOT gk AND x IS NOT NULL))[1:4]),0)",
    "mean_three_nearest_defender_dist": "coalesce(list_avg((list(d ORDER BY d) FILTER (NOT attacks AND d IS NOT NULL))[1:3]),105)",
}
_CONE = {
    "space_ahead_of_ball": "CASE WHEN max(bx) IS NULL THEN 0 ELSE least(coalesce(min(d) FILTER (NOT attacks AND x>bx AND abs(atan2(y-by_,greatest(x-bx,1e-6::DOUBLE)))<=pi()/4),105), greatest(52.5::DOUBLE-max(bx),0)) END",
}


def _feature_sql(columns: dict, parts: str, source: str, group: bool = True) -> str:
    out = ", ".join(f"{R(e)} AS {n}" for n, e in columns.items())
    return f"[{parts}] SELECT match_id, att AS attacking_team, frame, {out} FROM {source}" + (" GROUP BY match_id, att, frame" if group else "")


def _features(spark, d, names):
    return T.match_features(spark, d, names).select("match_id", "attacking_team", "frame", *[r6(n).alias(n) for n in names])


def _register_features(name: str, columns: dict, sql: str):
    query(name, sql)(lambda spark, d: _features(spark, d, list(columns)))


_PL_CEN = "(SELECT pl.*, cx, cy FROM pl JOIN cen USING (match_id, frame, att))"
_register_features("feat_ball", _BALL, _feature_sql(_BALL, "hyp bv", "(SELECT hyp.*, vx, vy FROM hyp JOIN bv USING (match_id, frame))", False))
_register_features("agg_conditional_counts", _ATTACK, _feature_sql(_ATTACK, "pl", "pl"))
_register_features("agg_shape_stats", _SHAPE, _feature_sql(_SHAPE, "pl cen", _PL_CEN))
_register_features("agg_nth_nearest", _NEAR, _feature_sql(_NEAR, "pl", "pl"))
_register_features("agg_k_smallest_mean", _KSMALL, _feature_sql(_KSMALL, "pl", "pl"))
_register_features("agg_cone_min", _CONE, _feature_sql(_CONE, "pl", "pl"))

_ALL = {**_ATTACK, **_SHAPE, **_NEAR, **_KSMALL, **_CONE}
_CONTEXT = {
    "possession_duration_s": "possession_duration_s", "possession_event_count": "possession_event_count", "is_dead_ball": "is_dead_ball::INT",
    "event_in_flight": "event_in_flight::INT", "recent_pass_count": "recent_pass_count", "recent_box_entry_count": "entries", "time_since_last_box_entry": "since",
}
_FEATURES_CTES = f"""fa AS (SELECT match_id, att, frame, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _ALL.items())} FROM {_PL_CEN} GROUP BY match_id, att, frame),
fb AS (SELECT h.match_id, h.att, h.frame, h.period, h.period_row, h.row_no, h.time_s, h.possession_team, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in {**_BALL, **_CONTEXT}.items())}
  FROM hyp h JOIN bv USING (match_id, frame) JOIN hist USING (match_id, att, frame)),
feat AS (SELECT * FROM fb JOIN fa USING (match_id, att, frame))"""
FEATURE_PARTS = "pl cen bv hyp hist"


@query("match_features", f"[{FEATURE_PARTS}] AND {_FEATURES_CTES} SELECT match_id, att AS attacking_team, period, count(*) AS n, "
       + ", ".join(f"{R(f'avg({f})')} AS {f}" for f in C.FEATURES) + " FROM feat GROUP BY 1, 2, 3")
def match_features(spark, d):
    f = T.match_features(spark, d)
    return f.groupBy("match_id", "attacking_team", "period").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(c)).alias(c) for c in C.FEATURES])


_SCORE = """CASE WHEN is_dead_ball>0.5::DOUBLE THEN 0 ELSE 1::DOUBLE/(1::DOUBLE+exp(-(-3.2::DOUBLE+3.6::DOUBLE*least(greatest((ball_x+1)/2,0),1)
 +0.9::DOUBLE*least(greatest(ball_v_goalward,0),12)/12+0.35::DOUBLE*least(greatest(attackers_ahead_of_ball,0),6)/6
 +0.55::DOUBLE*least(greatest(space_ahead_of_ball,0),30)/30-0.45::DOUBLE*least(greatest(defenders_within_10m_of_ball,0),6)/6))) END"""


_SCORE_SQL = f"""[pl bv hyp] AND fa AS (SELECT match_id, frame, att, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in {**_ATTACK, **_CONE}.items() if n in scoring.INPUTS)}
  FROM (SELECT pl.* FROM pl JOIN (SELECT match_id, frame, possession_team AS att FROM ctx) USING (match_id, frame, att)) GROUP BY match_id, frame, att),
feat AS (SELECT h.match_id, h.frame, h.att, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in {**_BALL, **_CONTEXT}.items() if n in scoring.INPUTS)},
  {', '.join(n for n in {**_ATTACK, **_CONE} if n in scoring.INPUTS)}
  FROM hyp h JOIN bv USING (match_id, frame) JOIN fa USING (match_id, frame, att))"""


@query("score_heuristic", f"{_SCORE_SQL} SELECT match_id, frame, att AS team, {R(_SCORE)} AS probability FROM feat")
def score_heuristic(spark, d):
    return T.scored(spark, d).select("match_id", "frame", "team", r6("probability").alias("probability"))


@query("chk_feature_schema", """[w] SELECT match_id, row_no, CASE row_no % 3 WHEN 0 THEN NULL WHEN 1 THEN 'schema_mismatch' ELSE 'model_unavailable' END AS service_reason FROM w""")
def chk_feature_schema(spark, d):
    from touchline.operators import editorial

    models = spark.createDataFrame([("good", schema.schema_hash()), ("old", "0" * 16)], "name string, feature_schema_hash string")
    w = S.windows(spark, d).withColumn("model", F.when(F.col("row_no") % 3 == 0, "good").when(F.col("row_no") % 3 == 1, "old").otherwise("gone"))
    return editorial.service_reason(w, models, schema.schema_hash()).select("match_id", "row_no", "service_reason")


# --- windows ----------------------------------------------------------------------------


@query("win_validity", f"""[frames] AND v AS (SELECT match_id, period, frame, ball_x IS NOT NULL AS has, count(*) OVER x AS n_frames,
    avg((ball_x IS NOT NULL)::INT) OVER x AS ratio FROM frames WINDOW x AS (PARTITION BY match_id, period ORDER BY frame ROWS BETWEEN 127 PRECEDING AND CURRENT ROW))
    SELECT match_id, period, frame, n_frames, {R('CASE WHEN n_frames<128 THEN 0 ELSE ratio END')} AS valid_ratio, n_frames>=128 AND ratio>=0.8::DOUBLE AND has AS window_valid,
    CASE WHEN n_frames<128 THEN 'insufficient_frames' WHEN ratio<0.8::DOUBLE OR NOT has THEN 'invalid_window' END AS invalid_reason FROM v""")
def win_validity(spark, d):
    return windows.window_validity(S.frames(spark, d)).select("match_id", "period", "frame", "n_frames", r6("valid_ratio").alias("valid_ratio"), "window_valid", "invalid_reason")


_PICKS = "SELECT i::INT AS step, round_even(i*124::DOUBLE/49::DOUBLE, 0)::BIGINT AS off FROM range(50) t(i)"


@query("win_subsample", f"[frames] AND pk AS ({_PICKS}) SELECT f.match_id, f.period, f.frame, sum(f.frame-124+off)::BIGINT AS pick_sum, count(*) AS n FROM frames f, pk WHERE f.period_row-1>=125 AND (f.period_row-1-125)%12=0 GROUP BY 1,2,3")
def win_subsample(spark, d):
    offsets = F.array(*map(F.lit, windows.picks()))
    rows = labels.stride_rows(S.frames(spark, d)).select("match_id", "period", "frame", F.explode(offsets).alias("o"))
    return rows.groupBy("match_id", "period", "frame").agg(F.sum(F.col("frame") - 124 + F.col("o")).alias("pick_sum"), F.count(F.lit(1)).alias("n"))


def _measured(spark, d, measure, output):
    f, s, _ = T.window_features(spark, d)
    return windows.measured_windows(f, s, measure, output, width=features.BLOCK)


_WIN = f"""[{FEATURE_PARTS} smp] AND {_FEATURES_CTES}, pk AS ({_PICKS}),
wr AS (SELECT s.match_id, s.frame, s.team, pk.step, f.* EXCLUDE (match_id, frame, att) FROM smp s, pk JOIN feat f ON f.match_id=s.match_id AND f.att=s.team AND f.frame=s.frame-124+pk.off)"""
_SUMMARY = C.FEATURES


@query("join_window_rows", f"{_WIN} SELECT match_id, frame, count(*) AS steps, {R('sum(step*ball_x)')} AS weighted_x, {R('sum(space_ahead_of_ball)')} AS space FROM wr GROUP BY 1, 2")
def join_window_rows(spark, d):
    ball, ahead = C.FEATURES.index("ball_x"), C.FEATURES.index("space_ahead_of_ball")

    def sums(x):
        return {"steps": [x.shape[1]] * len(x), "weighted_x": (x[:, :, ball] * range(x.shape[1])).sum(axis=1), "space": x[:, :, ahead].sum(axis=1)}

    m = _measured(spark, d, sums, "steps long, weighted_x double, space double")
    return m.select("match_id", F.col("row_no").alias("frame"), "steps", r6("weighted_x").alias("weighted_x"), r6("space").alias("space"))


@query("agg_window_summary", f"{_WIN} SELECT match_id, frame, " + ", ".join(
    f"{R(f'max(CASE WHEN step=49 THEN {f} END)')} AS last__{f}, {R(f'avg({f})')} AS mean__{f}, round(stddev_pop({f}),4) AS std__{f}, {R(f'max(CASE WHEN step=49 THEN {f} END)-max(CASE WHEN step=0 THEN {f} END)')} AS delta__{f}"
    for f in _SUMMARY) + " FROM wr GROUP BY 1, 2")
def agg_window_summary(spark, d):
    s = _measured(spark, d, windows.summary_of, ", ".join(f"{b}__{f} double" for b in ("last", "mean", "std", "delta") for f in _SUMMARY))
    return s.select("match_id", F.col("row_no").alias("frame"), *[
        (F.round(c, 4) if c.startswith("std") else r6(c)).alias(c) for f in _SUMMARY for c in (f"last__{f}", f"mean__{f}", f"std__{f}", f"delta__{f}")])


@query("windows", f"{_WIN} SELECT match_id, frame, count(*) AS steps, {len(C.FEATURES)}::BIGINT AS width, round(sum({'+'.join(f'{f}::FLOAT::DOUBLE' for f in C.FEATURES)}),3) AS total, "
       "round(sum(step*ball_x::FLOAT::DOUBLE),3) AS ordered_x, NULL::VARCHAR AS contract_error FROM wr GROUP BY 1, 2")
def window_arrays(spark, d):
    arrays = lambda x: {"window": [list(w) for w in x.astype("float32")]}
    w = windows.check_windows(_measured(spark, d, arrays, "window array<array<float>>"))
    add = lambda a, v: a + v.cast("double")
    place = C.FEATURES.index("ball_x")
    return w.select("match_id", F.col("row_no").alias("frame"), F.size("window").cast("long").alias("steps"), F.array_min(F.transform("window", F.size)).cast("long").alias("width"),
                    F.round(F.aggregate(F.flatten("window"), F.lit(0.0), add), 3).alias("total"),
                    F.round(F.aggregate(F.transform("window", lambda r, i: i * r[place].cast("double")), F.lit(0.0), lambda a, v: a + v), 3).alias("ordered_x"), "contract_error")


@query("set_union_matches", "[smp] SELECT match_id, count(*) AS n, count(*) FILTER (hit) AS positives, sum(row_no)::BIGINT AS places FROM smp GROUP BY 1")
def set_union_matches(spark, d):
    s = stage(T.samples(spark, d)[0])
    parts = [s.filter("match_id < 2"), s.filter("match_id >= 2").select(*reversed(s.columns))]
    return windows.union_matches(parts).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives"), F.sum("row_no").alias("places"))


#: rows of a window of embeddings; its faults follow the values: the first one's sign and size
_ROWS = 4


@query("chk_batch_contract", f"""SELECT vec_id, CASE WHEN v[1] > 0 AND v[2] > 0 THEN 'length' WHEN v[1] > 0 AND v[3] > 0 THEN 'width' WHEN v[1] > 0 THEN 'non_finite' END AS contract_error, len(v)//{_ROWS} AS width
    FROM (SELECT vec_id, embedding AS v FROM embeddings)""")
def chk_batch_contract(spark, d):
    """Whole vectors as windows of four rows; a row is taken, a value is taken or a value is broken where the vector says so."""
    e = S.read(spark, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] // _ROWS
    rows = F.transform(F.sequence(F.lit(0), F.lit(_ROWS - 1)), lambda i: F.slice("embedding", i * width + 1, width))
    v = lambda i: F.col("embedding")[i - 1] > 0
    broken = F.concat(F.array(F.transform(rows[0], lambda x: F.lit(float("nan")).cast("float"))), F.slice(rows, 2, _ROWS - 1))
    short = F.concat(F.array(F.slice(rows[0], 1, width - 1)), F.slice(rows, 2, _ROWS - 1))
    window = F.when(v(1) & v(2), F.slice(rows, 1, _ROWS - 1)).when(v(1) & v(3), short).when(v(1), broken).otherwise(rows)
    return windows.check_windows(e.select("vec_id", window.alias("window")), _ROWS, width).select("vec_id", "contract_error", F.lit(width).cast("long").alias("width"))


@query("agg_standardiser", f"[w] SELECT 'probability' AS feature, round(avg(probability),6) AS mean, round(stddev_pop(probability),6) AS scale FROM w UNION ALL SELECT 'team', round(avg(team),6), round(stddev_pop(team),6) FROM w UNION ALL SELECT 'flat', 1.0::DOUBLE, 1.0::DOUBLE")
def agg_standardiser(spark, d):
    w = S.windows(spark, d).withColumn("flat", F.lit(1.0))
    return windows.standardiser(w, ["probability", "team", "flat"]).select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query("agg_class_weight", "[w] SELECT count(*) AS n, sum(label)::BIGINT AS positives, round((count(*)-sum(label))::DOUBLE/sum(label),6) AS pos_weight FROM w")
def agg_class_weight(spark, d):
    return windows.class_weight(S.windows(spark, d)).withColumn("pos_weight", F.round("pos_weight", 6))


@query("win_train_val_split", """[w] AND c AS (SELECT match_id, quantile_cont(time_s, 0.8) AS cut FROM w GROUP BY 1), s AS (SELECT w.match_id, CASE WHEN time_s < cut-30 THEN 'train' WHEN time_s >= cut+30 THEN 'validation' END AS split, label, time_s FROM w JOIN c USING (match_id))
    SELECT match_id, split, count(*) AS n, sum(label)::BIGINT AS positives, max(time_s) AS last_s FROM s GROUP BY 1, 2""")
def win_train_val_split(spark, d):
    s = windows.train_val_split(S.windows(spark, d))
    return s.groupBy("match_id", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.max("time_s").alias("last_s"))
