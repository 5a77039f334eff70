"""Quality, orientation, evaluation, editorial, drift, degradation."""

from pyspark.sql import functions as F

from touchline import constants as C
from touchline.catalog import tables as T
from touchline.catalog.registry import R, query, r6
from touchline.operators import degrade, drift, editorial, evaluation, orientation, quality
from touchline.session import stage
from touchline.sources import star_tables as S

# --- quality ----------------------------------------------------------------------------

#: an imperfect arrival stream: every 40th frame twice, every 60th stepping back
_ARRIVALS_SQL = """AND ar AS (SELECT match_id, period, CASE WHEN frame % 60 = 0 THEN frame-7 ELSE frame END AS frame, time_s,
  row_number() OVER (PARTITION BY match_id ORDER BY frame, c) AS row_no FROM frames, range(2) t(c) WHERE c = 0 OR frame % 40 = 0),
dl AS (SELECT match_id, period, CASE WHEN lag(period) OVER w = period THEN frame-lag(frame) OVER w END AS d FROM ar WINDOW w AS (PARTITION BY match_id ORDER BY row_no))"""


def _arrivals(spark, d):
    from touchline.plans import segments

    f = S.frames(spark, d).withColumn(
        "c", F.explode(F.expr("CASE WHEN frame % 40 = 0 THEN array(0, 1) ELSE array(0) END"))).withColumn("_b", F.expr("floor(frame / 16384)"))
    n = segments.number_rows(f.drop("row_no"), ["match_id"], ["_b"], ["frame", "c"], name="row_no")
    return n.withColumn("frame", F.expr("CASE WHEN frame % 60 = 0 THEN frame - 7 ELSE frame END")).drop("c", "_b")


@query("win_frame_deltas", f"""[frames] {_ARRIVALS_SQL} SELECT match_id, period, count(*) FILTER (d=0) AS duplicates, count(*) FILTER (d>1) AS gaps,
    coalesce(max(d-1) FILTER (d>1),0) AS largest_gap, count(*) FILTER (d<0) AS backwards FROM dl GROUP BY 1, 2""")
def win_frame_deltas(spark, d):
    return quality.frame_deltas(_arrivals(spark, d)).select("match_id", "period", "duplicates", "gaps", "largest_gap", "backwards")


@query("join_events_in_range", """[frames ev] AND b AS (SELECT match_id, min(frame) AS lo, max(frame)//2 AS hi FROM frames GROUP BY 1)
    SELECT e.match_id, e.event_seq FROM ev e JOIN b USING (match_id) WHERE start_frame BETWEEN lo AND hi""")
def join_events_in_range(spark, d):
    bounds = quality.frame_bounds(S.frames(spark, d)).withColumn("hi", F.floor(F.col("hi") / 2))
    return quality.events_in_range(S.events(spark, d), bounds).select("match_id", "event_seq")


@query("win_out_of_order_events", """[ev] SELECT match_id, count(*) FILTER (start_frame < p) AS out_of_order FROM (
    SELECT match_id, start_frame, lag(start_frame) OVER (PARTITION BY match_id ORDER BY event_seq) AS p FROM ev) GROUP BY 1""")
def win_out_of_order_events(spark, d):
    return quality.out_of_order_events(S.events(spark, d))


@query("sort_events", "[ev] SELECT match_id, period, start_frame, event_seq FROM ev")
def sort_events(spark, d):
    return quality.sort_events(S.events(spark, d)).select("match_id", "period", "start_frame", "event_seq")


@query("agg_validation_report", f"""[ctx pos] AND c AS (SELECT match_id, count(*) AS n_frames, max(time_s)-min(time_s) AS dur, count(*) FILTER (ball_x IS NULL) AS bm,
      count(*) FILTER (NOT in_stoppage AND ball_x IS NULL)::DOUBLE/nullif(count(*) FILTER (NOT in_stoppage),0) AS live FROM ctx GROUP BY 1),
    p AS (SELECT match_id, avg((x IS NULL)::INT) AS miss, count(*) FILTER (x IS NOT NULL AND NOT (abs(x)<=57.5::DOUBLE AND abs(y)<=39::DOUBLE)) AS off FROM pos GROUP BY 1),
    e AS (SELECT match_id, count(*) AS t, count(*) FILTER (start_frame < p) AS o FROM (SELECT match_id, start_frame, lag(start_frame) OVER (PARTITION BY match_id ORDER BY event_seq) AS p FROM ev) GROUP BY 1)
    SELECT match_id, n_frames, {R('dur')} AS duration_s, 0 AS duplicate_frames, 0 AS frame_gaps, bm AS ball_missing, {R('bm::DOUBLE/n_frames')} AS ball_missing_ratio,
    {R('live')} AS ball_missing_ratio_in_play, {R('miss')} AS player_missing_ratio, off AS off_pitch_samples, t AS events_total, 0 AS events_dropped, o AS out_of_order,
    'ball missing in '||bm||' frames ('||printf('%.2f', bm::DOUBLE/n_frames*100)||'% of all frames)'||CASE WHEN off>0 THEN '; '||off||' player samples beyond the touchline' ELSE '' END
      ||CASE WHEN o>0 THEN '; '||o||' events arrived out of order and were sorted' ELSE '' END AS warnings
    FROM c JOIN p USING (match_id) JOIN e USING (match_id)""")
def agg_validation_report(spark, d):
    ctx = T.context(spark, d, True)
    r = quality.validation_report(stage(ctx), S.events(spark, d))
    return r.select("match_id", "n_frames", r6("duration_s").alias("duration_s"), "duplicate_frames", "frame_gaps", "ball_missing",
                    r6("ball_missing_ratio").alias("ball_missing_ratio"), r6("ball_missing_ratio_in_play").alias("ball_missing_ratio_in_play"),
                    r6("player_missing_ratio").alias("player_missing_ratio"), "off_pitch_samples", "events_total", "events_dropped", "out_of_order",
                    F.array_join("warnings", "; ").alias("warnings"))


@query("chk_files_agree", """[frames] AND a AS (SELECT *, CASE WHEN frame % 1000 = 0 THEN ball_x+0.25::DOUBLE ELSE ball_x END AS ax FROM frames WHERE ball_y IS NULL OR ball_y < 27::DOUBLE)
    SELECT f.match_id, count(*) AS n_frames, count(*) FILTER (a.frame IS NULL) AS only_home, 0 AS only_away, coalesce(max(abs(f.ball_x-a.ax)),0) AS max_ball_difference,
    false AS agree FROM frames f LEFT JOIN a USING (match_id, period, frame) GROUP BY 1""")
def chk_files_agree(spark, d):
    home = S.frames(spark, d)
    away = home.filter("ball_y IS NULL OR ball_y < 27D").withColumn("ball_x", F.expr("CASE WHEN frame % 1000 = 0 THEN ball_x + 0.25D ELSE ball_x END"))
    return quality.files_agree(home, away)


# --- orientation ------------------------------------------------------------------------

_PM = """pm AS (SELECT match_id, period, team, player_id, avg(x) AS mx, count(x) AS nx, sum(x) AS sx, count(*) AS nf FROM pos GROUP BY ALL),
gk AS (SELECT match_id, team, player_id FROM (SELECT match_id, team, player_id, max(abs(mx)) AS s FROM pm GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY match_id, team ORDER BY s DESC, player_id)=1)"""
_SIGNALS = f"""[pos ev] AND {_PM},
tm AS (SELECT match_id, period, team, sum(sx)/sum(nx) AS m, max(nf) AS n FROM pm GROUP BY ALL),
sg0 AS (SELECT match_id, period, team, 'pass_progression' AS name, 2 AS tier, avg(end_x-start_x) AS v, count(*) AS n, 1.5::DOUBLE AS sc, 0.75::DOUBLE AS wt FROM ev WHERE type IN ('pass','carry') AND start_x IS NOT NULL GROUP BY 1,2,3 HAVING count(*)>=20
 UNION ALL SELECT match_id, period, team, 'goalkeeper_position', 3, -mx, nx, 25, 0.65::DOUBLE FROM pm JOIN gk USING (match_id, team, player_id) WHERE nx>=100
 UNION ALL SELECT a.match_id, a.period, a.team, 'team_centroid', 3, b.m-a.m, a.n, 6, 0.65::DOUBLE FROM tm a JOIN tm b ON a.match_id=b.match_id AND a.period=b.period AND a.team<>b.team
 UNION ALL SELECT match_id, period, team, 'shot_geometry', 4, avg(start_x), count(*), 25, 0.35::DOUBLE*least(1,count(*)/5::DOUBLE) FROM ev WHERE type='shot' AND start_x IS NOT NULL GROUP BY 1,2,3),
sg AS (SELECT *, CASE WHEN v>=0 THEN 1 ELSE -1 END AS sign, wt*least(1,abs(v)/sc) AS strength FROM sg0),
vt AS (SELECT match_id, period, team, coalesce(sum(strength) FILTER (sign>0),0) AS up, coalesce(sum(strength) FILTER (sign<0),0) AS down FROM sg GROUP BY 1,2,3),
dv AS (SELECT match_id, period, team, CASE WHEN up>=down THEN 1 ELSE -1 END AS sign, CASE WHEN up+down>0 THEN greatest(up,down)/(up+down) ELSE 0 END AS agreement FROM vt)
"""


def _inferred(spark, d):
    means = stage(orientation.player_means(S.frames(spark, d, True)))
    keepers = orientation.goalkeepers(means, S.players(spark, declared=False))
    return means, keepers


@query("agg_goalkeeper", f"[pos] AND {_PM} SELECT match_id, team, player_id, 'inferred' AS goalkeeper_source FROM gk")
def agg_goalkeeper(spark, d):
    return _inferred(spark, d)[1]


@query("agg_orientation_signals", _SIGNALS + f"SELECT match_id, period, team, name, tier, sign, {R('strength')} AS strength, n AS sample_size FROM sg")
def agg_orientation_signals(spark, d):
    means, keepers = _inferred(spark, d)
    s = orientation.direction_signals(means, S.events(spark, d), keepers)
    return s.select("match_id", "period", "team", "name", "tier", "sign", r6("strength").alias("strength"), "sample_size")


@query("agg_orientation_vote", _SIGNALS + f"SELECT match_id, period, team, sign, {R('agreement')} AS agreement, agreement < 0.7::DOUBLE AS contradictory FROM dv")
def agg_orientation_vote(spark, d):
    means, keepers = _inferred(spark, d)
    v = orientation.direction_vote(orientation.direction_signals(means, S.events(spark, d), keepers))
    return v.select("match_id", "period", "team", "sign", r6("agreement").alias("agreement"), "contradictory")


@query("agg_structure_checks", _SIGNALS + """SELECT match_id, period, NULL::VARCHAR AS team, 'same_end' AS violation FROM dv GROUP BY 1,2 HAVING count(DISTINCT team)=2 AND count(DISTINCT sign)=1
    UNION ALL SELECT match_id, 2, team, 'no_change_of_ends' FROM dv GROUP BY match_id, team HAVING count(DISTINCT period)=2 AND count(DISTINCT sign)=1""")
def agg_structure_checks(spark, d):
    means, keepers = _inferred(spark, d)
    return orientation.structure_violations(stage(orientation.direction_vote(orientation.direction_signals(means, S.events(spark, d), keepers))))


@query("infer_orientation", _SIGNALS + f"""SELECT match_id, period, team, CASE WHEN match_id=1 AND period=1 AND team='home' THEN -1 ELSE sign END AS sign,
    CASE WHEN match_id=1 AND period=1 AND team='home' THEN 1 ELSE {R('agreement')} END AS agreement, CASE WHEN match_id=1 AND period=1 AND team='home' THEN 'override' ELSE 'inferred' END AS source,
    CASE WHEN match_id=1 AND period=1 AND team='home' THEN 'checked on video' END AS override_reason FROM dv""")
def infer_orientation(spark, d):
    o = spark.createDataFrame([(1, 1, "home", -1, "checked on video")], "match_id bigint, period int, team string, sign int, reason string")
    v, _ = orientation.infer_orientation(stage(S.frames(spark, d, True)), S.events(spark, d), S.players(spark, False), overrides=o)
    return v.select("match_id", "period", "team", "sign", r6("agreement").alias("agreement"), "source", "override_reason")


@query("src_declared_direction", """SELECT s_suppkey AS match_id, p::INT AS period, CASE WHEN p % 2 = 1 THEN CASE WHEN s_acctbal>=0 THEN 1 ELSE -1 END ELSE CASE WHEN s_acctbal>=0 THEN -1 ELSE 1 END END AS sign FROM supplier, range(1,5) t(p)""")
def src_declared_direction(spark, d):
    first = S.read(spark, d, "supplier").selectExpr("s_suppkey AS match_id", "'home' AS team", "CASE WHEN s_acctbal >= 0 THEN 1 ELSE -1 END AS sign")
    periods = first.selectExpr("match_id", "explode(sequence(1, 4)) AS period")
    return orientation.declared_directions(first, periods).select("match_id", "period", "sign")


# --- evaluation -------------------------------------------------------------------------

_CNT = """count(*) FILTER (probability>=0.8::DOUBLE AND label=1) AS tp, count(*) FILTER (probability>=0.8::DOUBLE AND label=0) AS fp, count(*) FILTER (probability<0.8::DOUBLE AND label=1) AS fn"""
_PRF = f"{R('coalesce(tp::DOUBLE/nullif(tp+fp,0),0)')} AS precision, {R('coalesce(tp::DOUBLE/nullif(tp+fn,0),0)')} AS recall"


@query("agg_window_metrics", f"""[w] AND m AS (SELECT match_id, count(*) AS n, sum(label)::BIGINT AS positives, {_CNT}, avg((probability-label)*(probability-label)) AS b, avg(label) AS r FROM w GROUP BY 1)
    SELECT match_id, n, positives, tp, fp, fn, {_PRF}, {R('coalesce(2::DOUBLE*tp/nullif(2*tp+fp+fn,0),0)')} AS f1, {R('b')} AS brier, {R('r')} AS base_rate FROM m""")
def agg_window_metrics(spark, d):
    m = evaluation.window_metrics(S.windows(spark, d), 0.8)
    return m.select("match_id", "n", "positives", "tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "brier", "base_rate")])


_AP = """h AS (SELECT match_id,probability,sum(label) tp,count(*) n FROM w GROUP BY 1,2),
k AS (SELECT match_id,tp,sum(tp) OVER o ctp, sum(n) OVER o cn, sum(tp) OVER (PARTITION BY match_id) tot FROM h WINDOW o AS (PARTITION BY match_id ORDER BY probability DESC)),
ap AS (SELECT match_id, sum(tp*1::DOUBLE/tot*ctp/cn) AS pr_auc FROM k GROUP BY 1)"""


@query("agg_average_precision", f"[w] AND {_AP} SELECT match_id, {R('pr_auc')} AS pr_auc FROM ap")
def agg_average_precision(spark, d):
    return evaluation.average_precision(S.windows(spark, d)).select("match_id", r6("pr_auc").alias("pr_auc"))


@query("agg_calibration", f"""[w] AND b AS (SELECT *, least(len(list_filter([i/10::DOUBLE FOR i IN range(11)], lambda e: e<=probability)),10)-1 AS bin FROM w)
    SELECT match_id, bin/10::DOUBLE AS bin_lower, (bin+1)/10::DOUBLE AS bin_upper, count(*) AS n, {R('avg(probability)')} AS mean_predicted, {R('avg(label)')} AS observed_rate FROM b GROUP BY match_id, bin""")
def agg_calibration(spark, d):
    return evaluation.calibration_bins(S.windows(spark, d)).withColumns({c: r6(c) for c in ("mean_predicted", "observed_rate")})


_ALARMS = """f AS (SELECT *, lag(time_s) OVER x pt, lag(team) OVER x pteam FROM w WHERE probability>=0.8::DOUBLE WINDOW x AS (PARTITION BY match_id ORDER BY row_no)),
g AS (SELECT *, sum(CASE WHEN pt IS NOT NULL AND time_s-pt<=2 AND team=pteam THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY row_no) a FROM f),
al AS (SELECT match_id, min(time_s) AS start_s, max(time_s) AS end_s, min(team) AS team, max(row_no)-min(row_no)+1 AS n_windows, max(probability) AS peak FROM g GROUP BY match_id, a)"""
#: queue form of the greedy matching: alarms of one team in order, pointer to the next free episode
_MATCH = f"""{_ALARMS},
ep AS (SELECT match_id, CASE team WHEN 'home' THEN 0 ELSE 1 END AS team, entry_time_s*12.5::DOUBLE AS entry_time_s, episode_id, row_number() OVER (PARTITION BY match_id, team ORDER BY entry_time_s) AS i FROM eps),
aj AS (SELECT al.*, row_number() OVER (PARTITION BY al.match_id, al.team ORDER BY start_s) AS k FROM al),
af AS (SELECT aj.match_id, aj.team, aj.k, aj.start_s, aj.end_s, coalesce(min(ep.i) FILTER (ep.entry_time_s>=aj.start_s), 1000000000) AS f, coalesce(max(ep.i) FILTER (ep.entry_time_s-5<=aj.end_s), 0) AS g
  FROM aj LEFT JOIN ep ON ep.match_id=aj.match_id AND ep.team=aj.team GROUP BY ALL),
mt AS (SELECT match_id, team, k, f, g, start_s, f AS p FROM af WHERE k=1
  UNION ALL SELECT a.match_id, a.team, a.k, a.f, a.g, a.start_s, greatest(CASE WHEN mt.p<=mt.g THEN mt.p+1 ELSE mt.p END, a.f) FROM mt JOIN af a ON a.match_id=mt.match_id AND a.team=mt.team AND a.k=mt.k+1),
mm AS (SELECT mt.match_id, mt.team, mt.start_s, ep.entry_time_s FROM mt JOIN ep ON ep.match_id=mt.match_id AND ep.team=mt.team AND ep.i=mt.p WHERE mt.p<=mt.g)"""


@query("win_group_alarms", f"[w] AND {_ALARMS} SELECT match_id, team, start_s, end_s, n_windows, peak FROM al")
def win_group_alarms(spark, d):
    return T.alarms(spark, d).select("match_id", "team", "start_s", "end_s", "n_windows", "peak")


@query("join_alarm_episode", f"[w eps] AND {_MATCH} SELECT match_id, team, start_s, {R('entry_time_s')} AS entry_time_s FROM mm")
def join_alarm_episode(spark, d):
    m = evaluation.match_alarms(stage(T.alarms(spark, d)), T.window_episodes(spark, d))
    return m.select("match_id", "team", "start_s", r6("entry_time_s").alias("entry_time_s"))


@query("join_unmatched_anti", f"[w eps] AND {_MATCH} SELECT al.match_id, al.team, al.start_s FROM al ANTI JOIN mm ON al.match_id=mm.match_id AND al.team=mm.team AND al.start_s=mm.start_s")
def join_unmatched_anti(spark, d):
    a = stage(T.alarms(spark, d))
    return a.join(evaluation.match_alarms(a, T.window_episodes(spark, d)), ["match_id", "team", "start_s"], "left_anti").select("match_id", "team", "start_s")


_EARLY = """ea AS (SELECT al.* FROM al ANTI JOIN mm ON al.match_id=mm.match_id AND al.team=mm.team AND al.start_s=mm.start_s),
er AS (SELECT * FROM ea WHERE EXISTS (SELECT 1 FROM ep WHERE ep.match_id=ea.match_id AND ep.team=ea.team AND ep.entry_time_s>ea.end_s AND ep.entry_time_s-ea.end_s<=15))"""


@query("join_early_semi", f"[w eps] AND {_MATCH}, {_EARLY} SELECT match_id, team, start_s FROM er")
def join_early_semi(spark, d):
    a, e = stage(T.alarms(spark, d)), stage(T.window_episodes(spark, d))
    return evaluation.early_alarms(a, evaluation.match_alarms(a, e), e).select("match_id", "team", "start_s")


_EM = f"""{_MATCH}, {_EARLY},
x AS (SELECT s.match_id, s.minutes, a.alarms, a.pa, coalesce(m.det,0) AS detected, coalesce(r.early,0) AS early_alarms, e.episodes, m.q1, m.q2, m.q3 FROM
 (SELECT match_id, (max(time_s)-min(time_s))/60::DOUBLE AS minutes FROM w GROUP BY 1) s
 JOIN (SELECT match_id, count(*) AS alarms, median(n_windows) AS pa FROM al GROUP BY 1) a USING (match_id)
 LEFT JOIN (SELECT match_id, count(*) AS det, quantile_cont(entry_time_s-start_s, 0.25) q1, quantile_cont(entry_time_s-start_s, 0.5) q2, quantile_cont(entry_time_s-start_s, 0.75) q3 FROM mm GROUP BY 1) m USING (match_id)
 LEFT JOIN (SELECT match_id, count(*) AS early FROM er GROUP BY 1) r USING (match_id) JOIN (SELECT match_id, count(*) AS episodes FROM ep GROUP BY 1) e USING (match_id))"""


@query("agg_episode_metrics", f"""[w eps] AND {_EM} SELECT match_id, episodes, alarms, detected, alarms-detected AS false_alarms, early_alarms, {R('detected::DOUBLE/alarms')} AS precision, {R('detected::DOUBLE/episodes')} AS recall,
    {R('2::DOUBLE*detected/(alarms+episodes)')} AS f1, {R('(alarms-detected)/minutes*90')} AS false_alarms_per_90, {R('q2')} AS median_warning_s, {R('q1')} AS warning_q25_s, {R('q3')} AS warning_q75_s, {R('pa')} AS median_windows_per_alarm FROM x""")
def agg_episode_metrics(spark, d):
    w = S.windows(spark, d)
    m = evaluation.episode_metrics(stage(T.alarms(spark, d)), stage(T.window_episodes(spark, d)), evaluation.match_spans(w))
    counts = ("match_id", "episodes", "alarms", "detected", "false_alarms", "early_alarms")
    return m.select(*[c if c in counts else r6(c).alias(c) for c in m.columns])


_EPC = """ec AS (SELECT ep.match_id, ep.team, ep.entry_time_s, arg_max(floor(w.row_no/25::DOUBLE)::BIGINT, w.time_s) FILTER (w.row_no IS NOT NULL) AS cluster_id FROM ep LEFT JOIN w ON w.match_id=ep.match_id AND w.team=ep.team
  AND w.time_s<=ep.entry_time_s AND w.time_s>=ep.entry_time_s-5 GROUP BY 1,2,3)"""


def _clustered(spark, d):
    return S.windows(spark, d).withColumn("cluster_id", F.expr("floor(row_no / 25D)"))


@query("join_episode_cluster", f"[w eps] AND {_MATCH}, {_EPC} SELECT match_id, team, {R('entry_time_s')} AS entry_time_s, cluster_id FROM ec")
def join_episode_cluster(spark, d):
    e = evaluation.episode_clusters(_clustered(spark, d), T.window_episodes(spark, d))
    return e.select("match_id", "team", r6("entry_time_s").alias("entry_time_s"), "cluster_id")


_DRAWS = """cl AS (SELECT DISTINCT match_id, floor(row_no/25::DOUBLE)::BIGINT AS cluster_id FROM w),
ci AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY cluster_id) AS i, count(*) OVER (PARTITION BY match_id) AS c FROM cl),
dr AS (SELECT match_id, r AS replicate, ('0x'||substr(md5('7:'||match_id||':'||r||':'||i),1,8))::BIGINT % c + 1 AS i FROM ci, range(2000) t(r)),
dw AS (SELECT dr.match_id, dr.replicate, ci.cluster_id, count(*) AS times FROM dr JOIN ci USING (match_id, i) GROUP BY 1,2,3)"""


@query("join_bootstrap_rows", f"""[w] AND {_DRAWS}, pc AS (SELECT match_id, floor(row_no/25::DOUBLE)::BIGINT AS cluster_id, {_CNT} FROM w GROUP BY 1,2),
    rp AS (SELECT match_id, replicate, sum(tp*times) AS tp, sum(fp*times) AS fp, sum(fn*times) AS fn FROM dw JOIN pc USING (match_id, cluster_id) GROUP BY 1,2)
    SELECT match_id, replicate, {R('coalesce(tp::DOUBLE/nullif(tp+fp,0),0)')} AS window_precision, {R('coalesce(tp::DOUBLE/nullif(tp+fn,0),0)')} AS window_recall FROM rp""")
def join_bootstrap_rows(spark, d):
    c = evaluation.bootstrap_window_counts(_clustered(spark, d), 0.8, seed=7)
    return c.selectExpr("match_id", "replicate", "coalesce(tp / nullif(tp + fp, 0), 0D) AS p", "coalesce(tp / nullif(tp + fn, 0), 0D) AS r").select(
        "match_id", "replicate", r6("p").alias("window_precision"), r6("r").alias("window_recall"))


@query("agg_percentile_ci", f"""[w] AND {_DRAWS}, pc AS (SELECT match_id, floor(row_no/25::DOUBLE)::BIGINT AS cluster_id, {_CNT} FROM w GROUP BY 1,2),
    rp AS (SELECT match_id, replicate, sum(tp*times) AS tp, sum(fp*times) AS fp, sum(fn*times) AS fn FROM dw JOIN pc USING (match_id, cluster_id) GROUP BY 1,2),
    lg AS (SELECT match_id, 'window_precision' AS metric, coalesce(tp::DOUBLE/nullif(tp+fp,0),0) AS v FROM rp UNION ALL SELECT match_id, 'window_recall', coalesce(tp::DOUBLE/nullif(tp+fn,0),0) FROM rp)
    SELECT match_id, metric, round(quantile_cont(v, 0.025),5) AS low, round(quantile_cont(v, 0.975),5) AS high FROM lg GROUP BY 1, 2""")
def agg_percentile_ci(spark, d):
    c = evaluation.bootstrap_window_counts(_clustered(spark, d), 0.8, seed=7)
    metrics = c.selectExpr("match_id", "coalesce(tp / nullif(tp + fp, 0), 0D) AS window_precision", "coalesce(tp / nullif(tp + fn, 0), 0D) AS window_recall")
    return evaluation.percentile_interval(metrics, ["window_precision", "window_recall"])


@query("cluster_bootstrap")
def cluster_bootstrap(spark, d):
    return evaluation.cluster_bootstrap(_clustered(spark, d), stage(T.window_episodes(spark, d)), 0.8, seed=7)


_GRID = "gr AS (SELECT i::INT AS grid_no, CASE WHEN i=93 THEN 0.98::DOUBLE ELSE 0.05::DOUBLE+i*((0.98::DOUBLE-0.05::DOUBLE)/93) END AS threshold FROM range(94) t(i))"


@query("threshold_by_budget", f"""[w eps] AND {_GRID},
f AS (SELECT grid_no, w.*, lag(time_s) OVER x pt, lag(team) OVER x pteam FROM w JOIN gr ON probability>=threshold WINDOW x AS (PARTITION BY grid_no, match_id ORDER BY row_no)),
g AS (SELECT *, sum(CASE WHEN pt IS NOT NULL AND time_s-pt<=2 AND team=pteam THEN 0 ELSE 1 END) OVER (PARTITION BY grid_no, match_id ORDER BY row_no) a FROM f),
al AS (SELECT grid_no, match_id, min(time_s) AS start_s, max(time_s) AS end_s, min(team) AS team FROM g GROUP BY grid_no, match_id, a),
ep AS (SELECT match_id, CASE team WHEN 'home' THEN 0 ELSE 1 END AS team, entry_time_s*12.5::DOUBLE AS e, row_number() OVER (PARTITION BY match_id, team ORDER BY entry_time_s) AS i FROM eps),
aj AS (SELECT *, row_number() OVER (PARTITION BY grid_no, match_id, team ORDER BY start_s) AS k FROM al),
a1 AS (SELECT aj.*, ep.i AS fi FROM aj ASOF LEFT JOIN ep ON ep.match_id=aj.match_id AND ep.team=aj.team AND aj.start_s<=ep.e),
af AS (SELECT a1.*, coalesce(fi,1000000000) AS f, coalesce(ep.i,0) AS g FROM (SELECT *, end_s+5 AS lim FROM a1) a1 ASOF LEFT JOIN ep ON ep.match_id=a1.match_id AND ep.team=a1.team AND a1.lim>=ep.e),
mt AS (SELECT grid_no, match_id, team, k, f, g, f AS p FROM af WHERE k=1 UNION ALL SELECT a.grid_no, a.match_id, a.team, a.k, a.f, a.g, greatest(CASE WHEN mt.p<=mt.g THEN mt.p+1 ELSE mt.p END, a.f)
  FROM mt JOIN af a ON a.grid_no=mt.grid_no AND a.match_id=mt.match_id AND a.team=mt.team AND a.k=mt.k+1),
mi AS (SELECT sum(m) AS minutes FROM (SELECT (max(time_s)-min(time_s))/60::DOUBLE AS m FROM w GROUP BY match_id)),
cv AS (SELECT gr.grid_no, threshold, coalesce(a.n,0) AS alarms, coalesce(b.n,0) AS detected, (coalesce(a.n,0)-coalesce(b.n,0))/(SELECT minutes FROM mi)*90 AS rate FROM gr LEFT JOIN (SELECT grid_no, count(*) AS n FROM al GROUP BY 1) a USING (grid_no)
  LEFT JOIN (SELECT grid_no, count(*) AS n FROM mt WHERE p<=g GROUP BY 1) b USING (grid_no))
SELECT {R('coalesce(min(threshold) FILTER (rate<=300 AND detected>0), arg_min(threshold, (rate, grid_no)))')} AS threshold, coalesce(bool_or(rate<=300 AND detected>0),false) AS within_budget, sum(alarms)::BIGINT AS alarms, sum(detected)::BIGINT AS detected FROM cv""")
def threshold_by_budget(spark, d):
    curve = stage(evaluation.alarm_budget_curve(stage(S.windows(spark, d)), stage(T.window_episodes(spark, d))))
    best = evaluation.threshold_by_budget(curve, 300.0).withColumn("_one", F.lit(1))
    totals = curve.agg(F.sum("alarms").alias("alarms"), F.sum("detected").alias("detected"), F.lit(1).alias("_one"))
    return best.join(totals, "_one").select(r6("threshold").alias("threshold"), "within_budget", "alarms", "detected")


_PGRID = "gr AS (SELECT i::INT AS grid_no, CASE WHEN i=90 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE+i*((0.95::DOUBLE-0.05::DOUBLE)/90) END AS threshold FROM range(91) t(i))"
_PCURVE = f"""{_PGRID}, pc AS (SELECT grid_no, threshold, count(*) FILTER (label=1 AND probability>=threshold) AS tp, count(*) FILTER (label=0 AND probability>=threshold) AS fp, count(*) FILTER (label=1 AND probability<threshold) AS fn FROM gr, w GROUP BY 1,2)"""


@query("precision_curve", f"[w] AND {_PCURVE} SELECT grid_no, {R('threshold')} AS threshold, tp, fp, fn, {_PRF} FROM pc")
def precision_curve(spark, d):
    c = evaluation.precision_curve(S.windows(spark, d))
    return c.select("grid_no", r6("threshold").alias("threshold"), "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("threshold_by_precision", f"""[w] AND {_PCURVE} SELECT {R("coalesce(min(threshold) FILTER (tp>0 AND tp::DOUBLE/(tp+fp)>=0.3::DOUBLE), arg_max(threshold, (coalesce(2::DOUBLE*tp/nullif(2*tp+fp+fn,0),0), -grid_no)))")} AS threshold,
    coalesce(bool_or(tp>0 AND tp::DOUBLE/(tp+fp)>=0.3::DOUBLE),false) AS reached_target FROM pc""")
def threshold_by_precision(spark, d):
    return evaluation.threshold_by_precision(evaluation.precision_curve(S.windows(spark, d))).withColumn("threshold", r6("threshold"))


@query("set_lomo_split", "[w] SELECT h::BIGINT AS held_out, count(*) AS n, sum(label)::BIGINT AS positives FROM w, range(4) t(h) WHERE match_id<>h GROUP BY 1")
def set_lomo_split(spark, d):
    f = evaluation.lomo_folds(S.windows(spark, d), [0, 1, 2, 3]).withColumn("held_out", F.col("held_out").cast("bigint"))
    return f.groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@query("agg_lomo", f"""[w eps] AND {_EM}, {_AP} SELECT 'rule' AS model, string_agg(match_id::VARCHAR, '|' ORDER BY match_id) AS folds, round(avg(round(pr_auc,12)),4) AS pr_auc_mean, round(avg(detected::DOUBLE/alarms),4) AS precision_mean, round(avg(detected::DOUBLE/episodes),4) AS recall_mean
    FROM x JOIN ap USING (match_id)""")
def agg_lomo(spark, d):
    w = stage(S.windows(spark, d))
    em = evaluation.episode_metrics(stage(T.alarms(spark, d)), stage(T.window_episodes(spark, d)), evaluation.match_spans(w))
    folds = em.join(evaluation.average_precision(w), "match_id").withColumn("model", F.lit("rule")).withColumnRenamed("match_id", "held_out")
    s = evaluation.lomo_summary(folds)
    return s.select("model", F.array_join(F.transform("folds", lambda x: x.cast("string")), "|").alias("folds"),
                    F.col("window_pr_auc_mean").alias("pr_auc_mean"), F.col("episode_precision_mean").alias("precision_mean"), F.col("episode_recall_mean").alias("recall_mean"))


_PAR = """p2 AS (SELECT match_id, row_no, probability AS a, probability*0.999::DOUBLE+(row_no%7)*1e-5::DOUBLE AS b FROM w),
rk AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY a, row_no) AS ra, row_number() OVER (PARTITION BY match_id ORDER BY b, row_no) AS rb FROM p2)"""


@query("join_score_parity", f"[w] AND {_PAR} SELECT match_id, count(*) AS samples, {R('max(abs(a-b))')} AS max_abs_diff, {R('avg(abs(a-b))')} AS mean_abs_diff, max(abs(a-b))<=1e-4::DOUBLE AS within_tolerance, max(abs(ra-rb)) AS max_rank_change FROM rk GROUP BY 1")
def join_score_parity(spark, d):
    w = stage(S.windows(spark, d).select("match_id", "row_no", "probability"))
    other = w.withColumn("probability", F.expr("probability * 0.999D + (row_no % 7) * 1e-5D"))
    p = evaluation.score_parity(w, other, ["match_id", "row_no"], ["match_id"])
    return p.withColumns({c: r6(c) for c in ("max_abs_diff", "mean_abs_diff")})


@query("win_rank_change", f"[w] AND {_PAR} SELECT match_id, row_no, abs(ra-rb) AS rank_change FROM rk")
def win_rank_change(spark, d):
    w = stage(S.windows(spark, d).selectExpr("match_id", "row_no", "probability AS a", "probability * 0.999D + (row_no % 7) * 1e-5D AS b"))
    r = evaluation.ranks(w, ["match_id"], {"ra": "a", "rb": "b"}, ["row_no"])
    return r.select("match_id", "row_no", F.abs(F.col("ra") - F.col("rb")).alias("rank_change"))


@query("agg_latency_stats", f"""SELECT event_type, count(*) AS iterations, {R('quantile_cont(value,0.5)')} AS p50_ms, {R('quantile_cont(value,0.95)')} AS p95_ms, {R('quantile_cont(value,0.99)')} AS p99_ms, {R('avg(value)')} AS mean_ms FROM events GROUP BY 1""")
def agg_latency_stats(spark, d):
    s = evaluation.latency_stats(S.read(spark, d, "events"), ["event_type"], "value")
    return s.select("event_type", "iterations", *[r6(c).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms", "mean_ms")])


# --- editorial --------------------------------------------------------------------------

#: scored rows on the window axis: every rule fires somewhere
_SCORED = {
    "window_valid": "row_no % 23 <> 0", "invalid_reason": "CASE WHEN row_no % 46 = 0 THEN 'insufficient_frames' WHEN row_no % 23 = 0 THEN 'invalid_window' END",
    "is_dead_ball": "CASE WHEN row_no % 11 = 0 THEN 1 ELSE 0 END", "ball_in_box": "CASE WHEN row_no % 13 = 0 THEN 1 ELSE 0 END",
    "recent_box_entry_count": "(row_no // 37) % 4", "possession_duration_s": "(row_no // 5) % 20",
}
_SC0 = "sc AS (SELECT w.*, " + ", ".join(f"{e} AS {n}" for n, e in _SCORED.items()) + """, probability+0 AS prob FROM w),
s1 AS (SELECT *, CASE WHEN NOT window_valid AND invalid_reason='insufficient_frames' THEN 'insufficient_frames' WHEN NOT window_valid THEN 'invalid_window' WHEN is_dead_ball=1 THEN 'dead_ball'
  WHEN ball_in_box=1 THEN 'already_in_box' WHEN probability<0.4::DOUBLE THEN 'low_confidence' END AS r0,
  CASE WHEN recent_box_entry_count>=2 AND possession_duration_s>=8 THEN 'sustained_pressure' WHEN probability>=0.4::DOUBLE+0.6::DOUBLE*0.45::DOUBLE THEN 'elevated_entry_chance' ELSE 'building_threat' END AS kd FROM sc)"""
#: from rows with the first rule that withholds them (r0) and their kind (kd) to outcomes
_POLICY = """s2 AS (SELECT *, CASE WHEN r0 IS NOT NULL THEN r0 WHEN coalesce(lag(r0) OVER (PARTITION BY match_id ORDER BY row_no),'x')<>'x' OR row_no=1 THEN 'not_yet_sustained' END AS r1 FROM s1),
so AS (SELECT match_id, kd, row_no, time_s, row_number() OVER (PARTITION BY match_id, kd ORDER BY row_no) AS k FROM s2 WHERE r1 IS NULL),
gc AS (SELECT match_id, kd, k, row_no, time_s, time_s AS a FROM so WHERE k=1 UNION ALL SELECT s.match_id, s.kd, s.k, s.row_no, s.time_s, CASE WHEN s.time_s-g.a<=45 THEN g.a ELSE s.time_s END FROM gc g JOIN so s ON s.match_id=g.match_id AND s.kd=g.kd AND s.k=g.k+1),
oc AS (SELECT s2.match_id, s2.row_no, s2.time_s, s2.team, CASE WHEN r0 IS NULL THEN s2.kd END AS kind, coalesce(r1, CASE WHEN gc.time_s-a=0 THEN NULL WHEN gc.time_s-a<20 THEN 'cooldown' ELSE 'duplicate_recent' END) AS reason, probability
  FROM s2 LEFT JOIN gc ON gc.match_id=s2.match_id AND gc.row_no=s2.row_no)"""
_SC = f"{_SC0},\n{_POLICY}"


def _scored_rows(spark, d):
    spark_sql = {n: e.replace("row_no // 37", "floor(row_no / 37)").replace("row_no // 5", "floor(row_no / 5)") for n, e in _SCORED.items()}
    zero = [f"0D AS {n}" for n in ("attackers_ahead_of_ball", "nearest_defender_dist", "defensive_line_x", "space_ahead_of_ball")]
    return S.windows(spark, d).selectExpr("*", "1 AS period", *[f"{e} AS {n}" for n, e in spark_sql.items()], *zero)


def outcomes(spark, d):
    return editorial.editorial_review(_scored_rows(spark, d), 0.4)


@query("editorial_review", f"[w] AND RECURSIVE_ {_SC} SELECT match_id, row_no, kind, reason, reason IS NULL AS emitted FROM oc")
def editorial_review(spark, d):
    return outcomes(spark, d).select("match_id", "row_no", "kind", "reason", "emitted")


@query("win_consecutive", f"[w] AND RECURSIVE_ {_SC} SELECT match_id, row_no, row_number() OVER (PARTITION BY match_id, b ORDER BY row_no)-CASE WHEN b>0 THEN 1 ELSE 0 END AS consecutive FROM (SELECT *, count(r0) OVER (PARTITION BY match_id ORDER BY row_no) AS b FROM s1)")
def win_consecutive(spark, d):
    from touchline.plans import segments

    rows = _scored_rows(spark, d)
    rows = rows.withColumn("_r", editorial.first_reason(rows, 0.4)).withColumn(segments.SEG, segments.segment_of(F.col("row_no"), 16384))
    c = segments.count_since(stage(rows), ["match_id"], ["row_no"], F.col("_r").isNotNull(), "consecutive", count_reset=False)
    return c.select("match_id", "row_no", "consecutive")


@query("win_greedy_cooldown", f"[w] AND RECURSIVE_ {_SC} SELECT match_id, kind, reason, count(*) AS n, min(row_no) AS first_row, max(row_no) AS last_row FROM oc WHERE reason IS NULL OR reason IN ('cooldown','duplicate_recent') GROUP BY 1, 2, 3")
def win_greedy_cooldown(spark, d):
    o = outcomes(spark, d).filter("reason IS NULL OR reason IN ('cooldown', 'duplicate_recent')")
    return o.groupBy("match_id", "kind", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))


@query("recent_insights", f"[w] AND RECURSIVE_ {_SC} SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY time_s DESC, row_no DESC) AS rank, row_no, kind FROM oc WHERE reason IS NULL QUALIFY rank <= 20")
def recent_insights(spark, d):
    return editorial.recent_insights(outcomes(spark, d)).select("match_id", "rank", "row_no", "kind")


@query("agg_suppression_rollup", f"""[w] AND RECURSIVE_ {_SC}, rl AS (SELECT match_id, (row_no-1)//25 AS interval, reason, count(*) AS n FROM oc GROUP BY 1,2,3)
    SELECT match_id, interval, sum(n)::BIGINT AS frames, coalesce(sum(n) FILTER (reason IS NULL),0)::BIGINT AS emitted, coalesce(string_agg(reason||'='||n, ',' ORDER BY reason) FILTER (reason IS NOT NULL),'') AS counts FROM rl GROUP BY 1,2""")
def agg_suppression_rollup(spark, d):
    r = editorial.suppression_rollup(outcomes(spark, d))
    entries = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return r.withColumn("counts", F.array_join(F.array_sort(entries), ","))


#: time from a window's last frame to its outcome, from less than the first bucket to more than the last
_LATENCY = "(row_no * 37 % 1301) / 1000"
_LE = {name: ",".join(f"({float(b)}::DOUBLE)" for b in buckets) + ",('inf'::DOUBLE)" for name, buckets in (("confidence", C.CONFIDENCE_BUCKETS), ("latency", C.LATENCY_BUCKETS))}


@query("agg_stage_counters", f"""[w] AND RECURSIVE_ {_SC}, lt AS (SELECT *, {_LATENCY}::DOUBLE AS latency_s FROM oc) SELECT 'outcomes' AS metric, reason, kind, NULL::DOUBLE AS le, count(*) AS n, NULL::DOUBLE AS total FROM lt GROUP BY 2, 3
    UNION ALL SELECT 'confidence', reason, kind, le, count(*) FILTER (probability<=le), {R('sum(probability)')} FROM lt, (VALUES {_LE['confidence']}) b(le) GROUP BY 2, 3, 4
    UNION ALL SELECT 'latency', reason, kind, le, count(*) FILTER (latency_s<=le), {R('sum(latency_s)')} FROM lt, (VALUES {_LE['latency']}) b(le) GROUP BY 2, 3, 4""")
def agg_stage_counters(spark, d):
    rows = outcomes(spark, d).withColumn("latency_s", F.expr(f"cast({_LATENCY} AS double)"))
    return editorial.stage_counters(rows, "reason", "kind").withColumn("total", r6("total"))


@query("agg_confidence_histogram", f"[w] SELECT match_id, le, count(*) FILTER (probability<=le) AS n, {R('sum(probability)')} AS total FROM w, (VALUES (0.05::DOUBLE),(0.1),(0.2),(0.3),(0.4),(0.5),(0.6),(0.7),(0.8),(0.9),(0.95),(1.0),('inf'::DOUBLE)) b(le) GROUP BY 1, 2")
def agg_confidence_histogram(spark, d):
    return editorial.histogram(S.windows(spark, d), "probability", keys=["match_id"]).select("match_id", "le", "n", r6("total").alias("total"))


@query("agg_latency_histogram", f"SELECT event_type, le, count(*) FILTER (value/100<=le) AS n, {R('sum(value/100)')} AS total FROM events, (VALUES (0.0005::DOUBLE),(0.001),(0.002),(0.005),(0.01),(0.02),(0.05),(0.1),(0.25),(0.5),(1.0),('inf'::DOUBLE)) b(le) GROUP BY 1, 2")
def agg_latency_histogram(spark, d):
    e = S.read(spark, d, "events").withColumn("v", F.col("value") / 100)
    return editorial.histogram(e, "v", C.LATENCY_BUCKETS, ["event_type"]).select("event_type", "le", "n", r6("total").alias("total"))


# --- drift ------------------------------------------------------------------------------

_PSI = """lo AS (SELECT CASE WHEN l_suppkey % 4 < 2 THEN 'r' ELSE 't' END AS side, unnest([{'f':'l_quantity','v':l_quantity},{'f':'l_extendedprice','v':l_extendedprice},{'f':'l_discount','v':l_discount}]) AS u FROM lineitem),
lg AS (SELECT side, u.f AS feature, u.v AS v FROM lo),
ed AS (SELECT feature, list_distinct(quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM lg WHERE side='r' GROUP BY 1),
bn AS (SELECT feature, side, len(list_filter(e, lambda x: x<=v)) AS bin, count(*) AS n FROM lg JOIN ed USING (feature) GROUP BY 1,2,3),
pv AS (SELECT feature, bin, coalesce(sum(n) FILTER (side='r'),0) AS r, coalesce(sum(n) FILTER (side='t'),0) AS t FROM bn GROUP BY 1,2),
pq AS (SELECT feature, greatest(r/sum(r) OVER (PARTITION BY feature),1e-6::DOUBLE) AS p, greatest(t/sum(t) OVER (PARTITION BY feature),1e-6::DOUBLE) AS q FROM pv),
ps AS (SELECT feature, sum((q-p)*ln(q/p)) AS psi FROM pq GROUP BY 1)"""


def _sides(spark, d):
    li = S.read(spark, d, "lineitem")
    return li.filter("l_suppkey % 4 < 2"), li.filter("l_suppkey % 4 >= 2")


@query("agg_psi", f"WITH {_PSI} SELECT feature, {R('psi')} AS psi FROM ps")
def agg_psi(spark, d):
    ref, tgt = _sides(spark, d)
    return drift.stability_index(ref, tgt, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("psi", r6("psi"))


@query("confidence_drift", f"[w] AND ed AS (SELECT list_distinct(quantile_cont(probability, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM w WHERE match_id<2), "
       "pv AS (SELECT len(list_filter(e, lambda x: x<=probability)) AS bin, count(*) FILTER (match_id<2) AS r, count(*) FILTER (match_id>=2) AS t FROM w, ed GROUP BY 1), "
       "pq AS (SELECT greatest(r/sum(r) OVER (),1e-6::DOUBLE) AS p, greatest(t/sum(t) OVER (),1e-6::DOUBLE) AS q FROM pv) "
       f"SELECT 'psi_model_confidence' AS name, {R('sum((q-p)*ln(q/p))')} AS value, sum((q-p)*ln(q/p))>0.25::DOUBLE AS violation FROM pq")
def confidence_drift(spark, d):
    w = S.windows(spark, d)
    return drift.confidence_drift(w.filter("match_id < 2"), w.filter("match_id >= 2")).select("name", r6("value").alias("value"), "violation")


@query("agg_drift_checks")
def agg_drift_checks(spark, d):
    f = stage(T.match_features(spark, d))
    s = stage(T.samples(spark, d)[0])
    side = lambda test: (f.filter(test), s.filter(test))
    (rf, rs), (tf, ts) = side("match_id < 2"), side("match_id >= 2")
    return drift.drift_checks(rf, tf, rs, ts)


@query("set_except_keys", "SELECT DISTINCT o_custkey AS custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_except_keys(spark, d):
    have = S.read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return S.read(spark, d, "orders").select(F.col("o_custkey").alias("custkey")).subtract(have)


# --- degradation ------------------------------------------------------------------------

_U = lambda k: f"(('0x'||substr(md5('3:'||match_id||':'||row_no||':{k}'),1,8))::BIGINT/4294967296::DOUBLE)"
_DEG = f"""dg AS (SELECT match_id, frame, row_no, {_U(1)} AS u1, {_U(2)}<0.03::DOUBLE AS was_delayed, {_U(4)}<0.01::DOUBLE AS was_reordered,
  (0+{_U(5)}*40)/1000::DOUBLE+CASE WHEN {_U(2)}<0.03::DOUBLE THEN (40+{_U(3)}*160)/1000::DOUBLE ELSE 0 END AS offset_s FROM frames WHERE {_U(0)}>=0.02::DOUBLE),
dx AS (SELECT *, c=1 AS is_duplicate, row_no-1+CASE WHEN was_reordered THEN 3 ELSE 0 END AS place FROM dg, range(2) t(c) WHERE c=0 OR u1<0.01::DOUBLE),
ds AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY place, row_no, c)-1 AS sequence FROM dx)"""


def _degraded(spark, d):
    return degrade.degrade_stream(S.frames(spark, d), "degraded", seed=3)


@query("degrade_stream", f"[frames] AND {_DEG} SELECT match_id, sequence, frame, round(offset_s*1000000)::BIGINT AS offset_us, is_duplicate, was_reordered FROM ds")
def degrade_stream(spark, d):
    return degrade.stream_signature(_degraded(spark, d))


@query("agg_fault_summary", f"""[frames] AND {_DEG} SELECT match_id, max(n) AS source_frames, count(*) AS emitted_frames, count(*) FILTER (is_duplicate) AS duplicated, count(*) FILTER (NOT is_duplicate AND was_delayed) AS delayed,
    count(*) FILTER (NOT is_duplicate AND was_reordered) AS reordered, max(n)-count(*) FILTER (NOT is_duplicate) AS dropped FROM ds JOIN (SELECT match_id, count(*) AS n FROM frames GROUP BY 1) USING (match_id) GROUP BY 1""")
def agg_fault_summary(spark, d):
    return degrade.degrade_summary(S.frames(spark, d), _degraded(spark, d))


@query("sort_emitted", f"[frames] AND {_DEG} SELECT match_id, sequence, row_no, is_duplicate FROM ds")
def sort_emitted(spark, d):
    return _degraded(spark, d).select("match_id", "sequence", "row_no", "is_duplicate")


@query("limit_replay", f"[frames] AND {_DEG} SELECT match_id, sequence, frame FROM ds WHERE sequence < 500")
def limit_replay(spark, d):
    return degrade.first_emitted(_degraded(spark, d), 500).select("match_id", "sequence", "frame")


@query("win_monotone_filter", f"""[frames] AND {_DEG}, mx AS (SELECT match_id, sequence, frame, max(frame) OVER (PARTITION BY match_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ds)
    SELECT match_id, sequence, coalesce(frame>newest,true) AS accepted, CASE WHEN frame>newest THEN frame-newest-1 ELSE 0 END AS missing FROM mx""")
def win_monotone_filter(spark, d):
    return degrade.accept_frames(_degraded(spark, d)).select("match_id", "sequence", "accepted", "missing")


@query("downsample", """[frames] AND kp AS (SELECT * FROM frames), st AS (SELECT *, round(time_s*1000000)::BIGINT AS us, min(round(time_s*1000000)::BIGINT) OVER (PARTITION BY match_id, period) AS t0 FROM kp),
    sl2 AS (SELECT match_id, period, (us-t0)//50000 AS slot, min(frame) AS frame FROM st GROUP BY 1,2,3) SELECT match_id, period, slot, frame, coalesce(slot-lag(slot) OVER (PARTITION BY match_id, period ORDER BY slot)-1, 0) AS skipped FROM sl2""")
def downsample(spark, d):
    return degrade.downsample(S.frames(spark, d)).select("match_id", "period", "slot", "frame", "skipped")
