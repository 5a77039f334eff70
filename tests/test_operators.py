"""Exact small cases, leakage checks, and results that may not depend on the segment width."""

import random

import pytest
from policy_plain import SCORED, policy_loop, scored_rows
from pyspark.sql import functions as F

from touchline.catalog import tables
from touchline import constants as C
from touchline import schema
from touchline.functions import text
from touchline.operators import (
    degrade, drift, editorial, evaluation, features, labels, orientation, possession, quality, shapes, windows,
)
from touchline.sources import star_tables as S

ENTRY = "match_id bigint, team string, period int, time_s double, frame bigint, row_no bigint"
EV = ("match_id bigint, event_seq bigint, team string, type string, start_frame bigint, end_frame bigint, period int, "
      "start_x double, start_y double, end_x double, end_y double")


def _entries(spark, rows):
    return spark.createDataFrame([(1, t, 1, float(s), i, i + 1) for i, (t, s) in enumerate(rows)], ENTRY)


@pytest.mark.parametrize("rows,gap,want", [
    ([("home", 10), ("home", 14), ("home", 40)], 10, [(10.0, 2), (40.0, 1)]),
    ([("home", 10), ("away", 12)], 30, [(10.0, 1), (12.0, 1)]),
    ([("home", 0), ("home", 8), ("home", 16)], 5, [(0.0, 1), (8.0, 1), (16.0, 1)]),
    ([("home", 0), ("home", 8), ("home", 16)], 10, [(0.0, 2), (16.0, 1)]),
    ([("home", 0), ("home", 8), ("home", 16)], 20, [(0.0, 3)]),
])
def test_merge_episodes(spark, rows, gap, want):
    got = labels.merge_episodes(_entries(spark, rows), gap).orderBy("entry_time_s").collect()
    assert [(r["entry_time_s"], r["n_entries"]) for r in got] == want


def test_possession_clusters(spark):
    rows = [(1, i + 1, t) for i, t in enumerate(["home"] * 3 + ["away"] * 2 + ["home"] * 2 + [None])]
    df = spark.createDataFrame(rows, "match_id bigint, row_no bigint, team string")
    got = [r["cluster_id"] for r in labels.possession_clusters(df, width=2).orderBy("row_no").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 3]


def _windows(spark, rows):
    return spark.createDataFrame(
        [(1, i + 1, float(t), team, float(p), y) for i, (t, team, p, y) in enumerate(rows)],
        "match_id bigint, row_no bigint, time_s double, team bigint, probability double, label int")


def test_window_metrics_silent_and_perfect(spark):
    silent = evaluation.window_metrics(_windows(spark, [(i, 0, 0, i % 2) for i in range(4)]), 0.5).first()
    perfect = evaluation.window_metrics(_windows(spark, [(i, 0, i % 2, i % 2) for i in range(4)]), 0.5).first()
    assert (silent["precision"], silent["recall"]) == (0.0, 0.0)
    assert (perfect["precision"], perfect["recall"], perfect["f1"]) == (1.0, 1.0, 1.0)


@pytest.mark.parametrize("bridge,n", [(2.0, 1), (0.5, 2), (0.0, 4)])
def test_alarm_bridging(spark, bridge, n):
    w = _windows(spark, [(i * 0.5, 0, 0.9 if i in (2, 3, 5, 6) else 0.1, 0) for i in range(9)])
    assert evaluation.group_alarms(w.filter("probability >= 0.5"), bridge_s=bridge).count() == n


def test_alarms_do_not_cross_teams_and_count_silent_windows(spark):
    two = _windows(spark, [(i * 0.5, int(i > 1), 0.9, 0) for i in range(4)])
    assert evaluation.group_alarms(two, bridge_s=5.0).count() == 2
    bridged = _windows(spark, [(i * 0.5, 0, 0.9 if i != 1 else 0.1, 0) for i in range(3)]).filter("probability > 0.5")
    assert evaluation.group_alarms(bridged, bridge_s=2.0).first()["n_windows"] == 3


def _episodes(spark, rows):
    return spark.createDataFrame([(1, t, float(e)) for t, e in rows], "match_id bigint, team bigint, entry_time_s double")


def test_episode_metrics_detection_and_false_alarm(spark):
    spans = spark.createDataFrame([(1, 90.0)], "match_id bigint, minutes double")
    fire = _windows(spark, [(8 + 0.5 * i, 0, 0.9, 1) for i in range(4)])
    hit = evaluation.episode_metrics(evaluation.group_alarms(fire), _episodes(spark, [(0, 10)]), spans).first()
    assert (hit["detected"], hit["recall"], hit["median_warning_s"]) == (1, 1.0, 2.0)
    early = _windows(spark, [(2 + 0.5 * i, 0, 0.9, 1) for i in range(3)])
    miss = evaluation.episode_metrics(evaluation.group_alarms(early), _episodes(spark, [(0, 50)]), spans).first()
    assert (miss["detected"], miss["false_alarms"], miss["early_alarms"]) == (0, 1, 0)


def _greedy(alarms, episodes, horizon):
    used, out = set(), []
    for s, e in alarms:
        for i, t in enumerate(episodes):
            if i not in used and s <= t and e >= t - horizon:
                used.add(i)
                out.append((s, t))
                break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_match_alarms_equals_greedy_loop(spark, seed):
    r = random.Random(seed)
    t, alarms = 0.0, []
    for _ in range(40):
        s = t + r.choice([2.5, 3.0, 4.0, 9.0])
        e = s + r.choice([0.0, 0.5, 6.0])
        alarms.append((s, e))
        t = e
    episodes = sorted([r.uniform(0, t + 10) for _ in range(30)])
    episodes = sorted(episodes + episodes[:5])  # repeated draws of one episode
    a = spark.createDataFrame([(1, 0, s, e) for s, e in alarms], "match_id bigint, team bigint, start_s double, end_s double")
    got = evaluation.match_alarms(a, _episodes(spark, [(0, x) for x in episodes])).select("start_s", "entry_time_s").collect()
    assert sorted(map(tuple, got)) == sorted(_greedy(alarms, episodes, 5.0))


def test_calibration_two_bins(spark):
    w = _windows(spark, [(i, 0, 0.05, 0) for i in range(50)] + [(i, 0, 0.95, 1) for i in range(50)])
    got = evaluation.calibration_bins(w).orderBy("bin_lower").collect()
    assert [r["observed_rate"] for r in got] == [0.0, 1.0]


def test_bootstrap_needs_two_clusters_and_brackets_the_value(spark):
    w = _windows(spark, [(i * 0.5, 0, 0.9 if i % 3 else 0.2, int(i % 3 == 1)) for i in range(120)])
    e = _episodes(spark, [(0, 7.0), (0, 31.0)])
    one = evaluation.cluster_bootstrap(w.withColumn("cluster_id", F.lit(0)), e, 0.5, replicates=20)
    assert one.count() == 0
    many = w.withColumn("cluster_id", F.floor(F.col("row_no") / 10))
    got = {r["metric"]: (r["low"], r["high"]) for r in evaluation.cluster_bootstrap(many, e, 0.5, replicates=60).collect()}
    value = evaluation.window_metrics(w, 0.5).first()["precision"]
    assert got["window_precision"][0] <= value <= got["window_precision"][1]
    assert "episode_recall" in got


def test_episode_bootstrap_equals_loop(spark):
    """Replicates recomputed row by row from the same draws."""
    r = random.Random(3)
    rows = [(i * 0.5, int(i // 30) % 2, r.choice([0.2, 0.9]), r.choice([0, 1])) for i in range(150)]
    w = _windows(spark, rows).withColumn("cluster_id", F.floor(F.col("row_no") / 15))
    eps = [(r.choice([0, 1]), round(r.uniform(0, 75), 2)) for _ in range(12)]
    draws = evaluation.bootstrap_draws(w, replicates=8, seed=1)
    got = {x["replicate"]: x for x in evaluation.bootstrap_episode_metrics(w, _episodes(spark, eps), draws, 0.5).collect()}
    times = {}
    for d in draws.collect():
        times.setdefault(d["replicate"], {})[d["cluster_id"]] = d["times"]
    cluster_of = {}
    for team, e in eps:
        c = [(i + 1) // 15 for i, x in enumerate(rows) if x[0] <= e and x[0] >= e - 5 and x[1] == team]
        cluster_of[(team, e)] = c[-1] if c else None
    for rep, drawn in times.items():
        firing = [(x[0], x[1]) for i, x in enumerate(rows) if x[2] >= 0.5 and (i + 1) // 15 in drawn]
        alarms, prev = [], None
        for t, team in firing:
            if prev and t - prev[0] <= 2 and team == prev[1]:
                alarms[-1][1] = t
            else:
                alarms.append([t, t, team])
            prev = (t, team)
        kept = sorted((e, team) for team, e in eps if cluster_of[(team, e)] in drawn for _ in range(drawn[cluster_of[(team, e)]]))
        detected = sum(len(_greedy([(s, e) for s, e, k in alarms if k == team], [e for e, k in kept if k == team], 5.0)) for team in (0, 1))
        assert got[rep]["episode_precision"] == pytest.approx(detected / len(alarms) if alarms else 0.0)
        assert got[rep]["episode_recall"] == pytest.approx(detected / len(kept) if kept else 0.0)


# --- possession, features ---------------------------------------------------------------


def _ev(rows):
    return [(1, i, team, kind, s, e, 1, 0.0, 0.0, 1.0, 1.0) for i, (team, kind, s, e) in enumerate(rows)]


def _frames(spark, n):
    return spark.createDataFrame(
        [(1, 1, i, i / 25.0, 40.0 if 5 <= i <= 7 else 0.0, 0.0, i, i) for i in range(1, n + 1)],
        "match_id bigint, period int, frame bigint, time_s double, ball_x double, ball_y double, row_no bigint, period_row bigint")


def _loop_possession(events, now):
    seen = [e for e in events if e[4] <= now]
    on = [e for e in seen if e[3] in C.ON_BALL_TYPES]
    run = []
    for e in reversed(on):
        if run and e[2] != run[0][2]:
            break
        run.append(e)
    latest = seen[-1] if seen else None
    mask = False
    for e in seen:
        if e[3] in C.DEAD_BALL_TYPES:
            mask = True
        elif e[3] in C.ON_BALL_TYPES:
            mask = False
    recent = sum(e[3] in C.PROGRESS_TYPES and now - 250 <= e[4] for e in seen)
    return (run[0][2] if run else None, (now - run[-1][4]) / 25 if run else 0.0, len(run),
            bool(latest and latest[3] in C.DEAD_BALL_TYPES), bool(latest and latest[5] > now), mask, recent)


@pytest.mark.parametrize("width", [16, 100, 16384])
def test_possession_context_equals_loop_for_any_segment_width(spark, width):
    r = random.Random(9)
    starts = sorted(r.randint(1, 700) for _ in range(90))
    events = _ev([(r.choice(C.TEAMS), r.choice(C.EVENT_TYPES), s, s + r.randint(0, 30)) for s in starts])
    out = possession.possession_context(_frames(spark, 800), spark.createDataFrame(events, EV), width=width)
    got = {x["frame"]: (x["possession_team"], x["possession_duration_s"], x["possession_event_count"], x["is_dead_ball"],
                        x["event_in_flight"], x["in_stoppage"], x["recent_pass_count"]) for x in out.collect()}
    assert len(got) == 800
    for now in range(1, 801):
        assert got[now] == _loop_possession(events, now)


def test_runs_equal_for_any_segment_width(spark, sf):
    ev = S.events(spark, sf)
    wide = possession.possession_runs(ev).select("event_seq", "run_start", "run_events")
    narrow = possession.possession_runs(ev, width=50).select("event_seq", "run_start", "run_events")
    assert sorted(wide.collect()) == sorted(narrow.collect())


def test_context_is_blind_to_the_future(spark):
    events = _ev([("home", "pass", 5, 9), ("home", "carry", 20, 25), ("away", "shot", 40, 60), ("home", "ball_out", 70, 70)])
    frames = _frames(spark, 100)
    now = 45
    tampered = [e if e[4] <= now else (*e[:2], "away", "recovery", e[4], 999, *e[6:]) for e in events]
    tampered = [e[:5] + (e[5] + 500,) + e[6:] if e[5] > now else e for e in tampered]
    a = possession.possession_context(frames, spark.createDataFrame(events, EV)).filter(F.col("frame") <= now)
    b = possession.possession_context(frames, spark.createDataFrame(tampered, EV)).filter(F.col("frame") <= now)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    seen = possession.visible_events(frames, spark.createDataFrame(events, EV), 100).filter("frame = 45 and event_seq = 2").first()
    assert seen["resolved"] is False and seen["end_frame"] is None and seen["end_x"] is None


def test_entry_history_excludes_its_own_entry(spark):
    f = _frames(spark, 10).withColumn("time_s", F.col("frame").cast("double"))
    o = spark.createDataFrame([(1, 1, "home", 1), (1, 1, "away", -1)], "match_id bigint, period int, team string, sign int")
    got = {r["frame"]: r for r in features.box_entry_history(f, o, lookback_s=60.0).collect()}
    assert got[5]["home_entries"] == 0 and got[6]["home_entries"] == 1
    assert got[5]["home_since"] == 60.0 and got[6]["home_since"] == 1.0
    assert got[6]["away_entries"] == 0


def test_features_do_not_depend_on_the_block_width(spark, sf):
    ctx = possession.possession_context(S.frames(spark, sf, True), S.events(spark, sf))
    ctx = ctx.filter("match_id = 0")
    o = S.orientation(spark)
    cols = ["frame", "attacking_team", "ball_speed", "attack_mean_v_goalward", "recent_box_entry_count", "time_since_last_box_entry"]
    wide = features.match_features(ctx, o).select(*cols).collect()
    # blocks of 301 rows, lookback scaled to fit: velocities are compared, and history with a short lookback
    narrow = features.velocities(ctx, width=64).select("frame", "ball_vx", "ball_vy")
    whole = features.velocities(ctx).select("frame", "ball_vx", "ball_vy")
    assert sorted(narrow.collect(), key=str) == sorted(whole.collect(), key=str)
    short = features.box_entry_history(ctx, o, lookback_s=4.0, width=128)
    long = features.box_entry_history(ctx, o, lookback_s=4.0)
    pick = ["frame", "home_entries", "away_entries", "home_since", "away_since"]
    assert sorted(short.select(*pick).collect()) == sorted(long.select(*pick).collect())
    assert len(wide) == 2 * ctx.count()


def test_schema_hash_is_stable_and_order_sensitive():
    assert schema.schema_hash() == "37eda41cef0a592c"
    assert schema.schema_hash(C.FEATURES[::-1]) != schema.schema_hash()
    with pytest.raises(ValueError):
        schema.schema_hash(("a", "a"))
    with pytest.raises(KeyError):
        schema.check_columns(["ball_x"])


def test_picks_keep_the_last_row():
    assert windows.picks()[0] == 0 and windows.picks()[-1] == 124 and len(set(windows.picks())) == 50
    assert windows.picks(10, 1) == [9]
    with pytest.raises(ValueError):
        windows.picks(0)


# --- editorial --------------------------------------------------------------------------

@pytest.mark.parametrize("seed,late,width", [(1, False, 16384), (2, False, 16), (3, True, 16384), (4, True, 16)])
def test_editorial_review_equals_loop(spark, seed, late, width):
    rows = scored_rows(random.Random(seed), 300)
    df = spark.createDataFrame(rows, SCORED)
    if late:
        # reviews arrive in time order: lateness may not reorder them
        rows = [(*x[:3], max(x[3], max(y[3] for y in rows[: i + 1])), *x[4:]) for i, x in enumerate(rows)]
        df = spark.createDataFrame(rows, SCORED)
    else:
        df = df.drop("now_s")
    got = [r["reason"] for r in editorial.editorial_review(df, 0.5, width=width).orderBy("row_no").collect()]
    assert got == policy_loop(rows, late)


def test_wording(spark):
    df = spark.createDataFrame([(h,) for h in C.HEADLINES.values()] + [("They will score",), ("A likely goal is certain",)], "t string")
    assert [r[0] for r in df.select(text.is_hedged(F.col("t"))).collect()] == [True, True, True, False, False]


# --- orientation, quality, drift, degradation -------------------------------------------


def test_orientation_vote_and_overrides(spark):
    sig = "match_id bigint, period int, team string, name string, tier int, sign int, margin double, sample_size bigint, value double, strength double"
    rows = [(1, 1, "home", "provider_metadata", 1, 1, 1.0, 1, 1.0, 1.0), (1, 1, "home", "pass_progression", 2, -1, 0.5, 30, -1.0, 0.375),
            (1, 1, "away", "team_centroid", 3, -1, 0.5, 10, -1.0, 0.3), (1, 1, "away", "shot_geometry", 4, -1, 1.0, 10, -1.0, 0.35)]
    votes = orientation.direction_vote(spark.createDataFrame(rows, sig))
    got = {r["team"]: r for r in votes.collect()}
    assert got["home"]["sign"] == 1 and got["home"]["contradictory"]  # a strong signal against the metadata
    assert got["away"]["sign"] == -1 and not got["away"]["contradictory"] and got["away"]["source"] == "inferred"
    with pytest.raises(ValueError):
        orientation.require_orientation(votes)
    o = "match_id bigint, period int, team string, sign int, reason string"
    fixed = orientation.apply_overrides(votes, spark.createDataFrame([(1, 1, "home", 1, "seen on video")], o))
    assert {r["team"]: r["source"] for r in fixed.collect()}["home"] == "override"
    with pytest.raises(Exception, match="needs a reason"):
        orientation.apply_overrides(votes, spark.createDataFrame([(1, 1, "home", 1, " ")], o)).collect()


def test_structure_violations(spark):
    rows = [(1, 1, "home", 1), (1, 1, "away", 1), (1, 2, "home", 1), (1, 2, "away", -1)]
    got = orientation.structure_violations(spark.createDataFrame(rows, "match_id bigint, period int, team string, sign int"))
    assert sorted(r["violation"] for r in got.collect()) == ["no_change_of_ends", "same_end"]


def test_validation_names_fatal_problems(spark, sf):
    f = S.frames(spark, sf, True).filter("match_id = 0").withColumn("in_stoppage", F.lit(False)).withColumn("ball_x", F.lit(None).cast("double"))
    report = quality.validation_report(f, S.events(spark, sf).filter("match_id = 0").withColumn("start_frame", F.lit(10**9).cast("bigint")))
    assert set(report.first()["problems"]) >= {"ball_coverage", "no_events_in_range"}
    with pytest.raises(ValueError, match="ball_coverage"):
        quality.raise_if_fatal(report)


def test_psi_is_zero_for_equal_tables(spark, sf):
    li = S.read(spark, sf, "lineitem")
    assert drift.stability_index(li, li, ["l_quantity"]).first()["psi"] == pytest.approx(0.0)
    shifted = li.withColumn("l_quantity", F.col("l_quantity") + 30)
    assert drift.stability_index(li, shifted, ["l_quantity"]).first()["psi"] > C.PSI_LIMIT


def test_degradation_is_deterministic_and_clean_is_identity(spark, sf):
    f = S.frames(spark, sf)
    sig = lambda df: sorted(map(tuple, degrade.stream_signature(df).collect()))
    assert sig(degrade.degrade_stream(f, "hostile", 5)) == sig(degrade.degrade_stream(f.repartition(7), "hostile", 5))
    assert sig(degrade.degrade_stream(f, "hostile", 5)) != sig(degrade.degrade_stream(f, "hostile", 6))
    clean = degrade.degrade_stream(f, "clean")
    assert clean.filter("sequence <> row_no - 1 or offset_s <> 0 or is_duplicate").count() == 0 and clean.count() == f.count()


def test_bootstrap_counts_in_blocks_equal_joined_draws(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "DRAW_BLOCK", 4)
    r = random.Random(3)
    rows = [(m, i, i * 0.5, 0, r.choice([0.1, 0.6, 0.9]), r.randint(0, 1), i // 3 + (i // 50) * 7) for m, n in ((0, 130), (1, 2), (2, 40)) for i in range(n)]
    w = spark.createDataFrame(rows, "match_id bigint, row_no bigint, time_s double, team bigint, probability double, label int, cluster_id bigint")
    joined = w.join(evaluation.bootstrap_draws(w, replicates=12, seed=5), ["match_id", "cluster_id"])
    plain = evaluation.window_counts(joined, 0.5, ["match_id", "replicate"], F.col("times"))
    want = {(x["match_id"], x["replicate"]): (x["tp"], x["fp"], x["fn"]) for x in plain.collect()}
    counted = evaluation.bootstrap_window_counts(w, 0.5, replicates=12, seed=5)
    got = {(x["match_id"], x["replicate"]): (x["tp"], x["fp"], x["fn"]) for x in counted.collect()}
    # a match of one cluster has no replicate
    assert got == want and {m for m, _ in got} == {0, 2} and len(got) == 24
    # the replicates are dealt out by number of tasks, however few rows their table has
    assert "REPARTITION_BY_NUM" in counted._jdf.queryExecution().toString()


def test_players_made_of_columns_are_made_behind_the_windows(spark, sf, capsys):
    orientation = S.orientation(spark)
    made = features.match_features(tables.sourced_context(spark, sf), orientation, players=S.PLAYERS)
    made.explain()
    windows_of = [line for line in capsys.readouterr().out.splitlines() if "Window [" in line]
    assert windows_of and not [line for line in windows_of if "players" in line]
    keys = ["match_id", "attacking_team", "frame"]
    some = lambda df: df.filter("frame <= 40").select(*keys, "attack_mean_v_goalward", "defence_mean_v_goalward", "gk_dist_to_ball").orderBy(*keys).collect()
    assert some(made) == some(features.match_features(tables.context(spark, sf, players=True), orientation))


def test_bootstrap_in_blocks_equals_drawn_rows(spark, monkeypatch):
    """Scores and alarms added up in blocks, with stretches that fit a time block and ones that do not."""
    monkeypatch.setattr(evaluation, "DRAW_BLOCK", 4)
    r = random.Random(8)
    rows = [(m, i, i * 0.5, (i // 9) % 2, r.choice([0.1, 0.2, 0.6, 0.9]) if i % 60 > 14 else 0.1, r.randint(0, 1), i // 3 + (i // 50) * 7)
            for m, n in ((0, 240), (1, 2), (2, 40)) for i in range(n)]
    w = spark.createDataFrame(rows, "match_id bigint, row_no bigint, time_s double, team bigint, probability double, label int, cluster_id bigint")
    eps = _episodes(spark, [(r.choice([0, 1]), round(r.uniform(0, 120), 1)) for _ in range(40)])
    eps = eps.withColumn("match_id", F.when(F.rand(1) < 0.8, 0).otherwise(2).cast("bigint")).localCheckpoint()
    draws = evaluation.bootstrap_draws(w, replicates=70, seed=5).localCheckpoint()
    keys = ["match_id", "replicate"]
    indexed = evaluation._numbered_clusters(w)
    drawn = evaluation._draw_blocks(indexed, 70, 5)

    joined = w.join(draws, ["match_id", "cluster_id"])
    area = {(x[0], x[1]): x[2] for x in evaluation.average_precision(joined, keys, F.col("times")).collect()}
    scores = evaluation.bootstrap_window_metrics(evaluation.bootstrap_scores(w, indexed, drawn), 0.5)
    assert {(x[0], x[1]): x["window_pr_auc"] for x in scores.collect()} == pytest.approx(area)

    ratio = lambda a, b: a / b if b else 0.0
    plain = evaluation.bootstrap_episode_metrics(w, eps, draws, 0.5).collect()
    want = {(x["match_id"], x["replicate"], i): x[of] for x in plain for i, of in enumerate(("episode_precision", "episode_recall"))}
    for width in (900.0, 12.0):
        counts = evaluation.bootstrap_alarm_counts(w, eps, indexed, drawn, 0.5, 70, width=width).collect()
        got = {(x["match_id"], x["replicate"], i): ratio(x["detected"], x[of]) for x in counts for i, of in enumerate(("alarms", "episodes"))}
        assert got == pytest.approx(want) and any(0 < x["detected"] < x["alarms"] for x in counts)


def test_some_features_are_those_of_all_and_cost_no_more_than_they_need(spark):
    sf, names = "/root/testdata/sf0.001", ("defensive_line_x", "mean_three_nearest_defender_dist", "ball_speed")
    narrow, whole = tables.match_features(spark, sf, names), tables.match_features(spark, sf)
    some = lambda rows: sorted(map(tuple, rows.filter("match_id = 1 AND frame < 400").select("attacking_team", "frame", *names).collect()))
    assert some(narrow) == some(whole)
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert "spread" not in plan and "home_entries" not in plan and "_pair" not in plan


def test_stage_counters_keep_both_histograms(spark):
    rows = spark.createDataFrame(
        [("dead_ball", 0.05, 0.0005), ("dead_ball", 0.06, 2.0), ("dead_ball", None, None), (None, 1.0, 0.3)], "reason string, probability double, latency_s double")
    got = {(r.metric, r.reason, r.le): (r.n, r.total) for r in editorial.stage_counters(rows, "reason").collect()}
    assert len(got) == 2 * (1 + len(C.CONFIDENCE_BUCKETS) + 1 + len(C.LATENCY_BUCKETS) + 1)
    assert got["outcomes", "dead_ball", None] == (3, None) and got["outcomes", None, None] == (1, None)
    of = lambda metric, reason: [n for (m, r, _), (n, _) in sorted(got.items(), key=lambda i: i[0][2] or 0) if (m, r) == (metric, reason)]
    assert of("confidence", "dead_ball") == [1] + [2] * 12 and of("confidence", None) == [0] * 11 + [1, 1]
    assert of("latency", "dead_ball") == [1] * 11 + [2] and of("latency", None) == [0] * 9 + [1, 1, 1]
    assert got["confidence", "dead_ball", 1.0][1] == pytest.approx(0.11) and got["latency", None, 1.0][1] == pytest.approx(0.3)


def test_players_are_measured_in_batches_as_one_by_one(spark):
    """Squads of unequal size, a squad of one, no keeper, unknown places: against plain loops."""
    r = random.Random(4)
    place = lambda: None if r.random() < 0.2 else r.randint(-52, 52) * 1.0
    squad = lambda: [(r.choice(C.TEAMS), f"p{i}", r.random() < 0.2, place(), place(), None if r.random() < 0.2 else r.uniform(-3, 3)) for i in range(r.randint(0, 7))]
    rows = [(i, squad(), place(), place(), *r.choice([(1, -1), (-1, 1)])) for i in range(400)] + [(400, None, 1.0, 2.0, 1, -1)]
    df = spark.createDataFrame(rows, "i int, players array<struct<team:string,player_id:string,is_gk:boolean,x:double,y:double,vx:double>>, ball_x double, ball_y double, home_sign int, away_sign int")
    lists = {c: F.col(f"players.{c}") for c in ("team", "is_gk", "x", "y", "vx")}
    table = df.withColumn("f", shapes.frame_features(list(shapes.FEATURES), lists))
    assert "sort_array" not in table._jdf.queryExecution().toString()
    got = {x["i"]: x["f"] for x in table.collect()}
    mean = lambda v, other: sum(v) / len(v) if v else other
    sd = lambda v: mean([(x - mean(v, 0)) ** 2 for x in v], 0) ** 0.5
    for i, players, bx, by, *signs in rows:
        players = players or []
        for side, s in zip(C.TEAMS, signs, strict=True):
            a, d = ([p for p in players if (p[0] == side) == mine] for mine in (True, False))
            far = lambda team: sorted(((p[3] - bx) ** 2 + (p[4] - by) ** 2) ** 0.5 for p in team if None not in (p[3], p[4], bx, by))
            xs = lambda team: sorted(p[3] * s for p in team if not p[2] and p[3] is not None)
            known = [p for p in d if p[3] is not None]
            gk = next((p for p in d if p[2]), min(known, key=lambda p: (p[3] * s, -99 if p[4] is None and s > 0 else 99 if p[4] is None else p[4] * s)) if known else None)
            goal = ((gk[3] * s - 52.5) ** 2 + gk[4] ** 2) ** 0.5 if gk and None not in gk[3:5] else C.FAR_M
            second = lambda team: (far(team) + [C.FAR_M] * 2)[1 if len(team) > 1 else 0]
            speeds = [p[5] for p in a if p[5] is not None]
            want = {
                "attackers_ahead_of_ball": sum(p[3] * s > bx * s for p in a if p[3] is not None and bx is not None),
                "attackers_in_box": sum(p[3] * s >= C.BOX_X_MIN and abs(p[4]) <= C.BOX_Y_MAX for p in a if None not in p[3:5]),
                "attack_centroid_x": mean(xs(a), 0.0), "attack_depth": sd(xs(a)), "attack_width": sd([p[4] for p in a if not p[2] and p[4] is not None]),
                "attack_highest_x": max(xs(a), default=0.0), "attack_mean_v_goalward": mean(speeds, 0.0) * s,
                "attackers_moving_goalward": sum(v * s > 0.5 for v in speeds), "defensive_line_x": mean(xs(d)[:4], 0.0),
                "gk_dist_to_goal": goal, "nearest_defender_dist": (far(d) + [C.FAR_M])[0], "second_nearest_defender_dist": second(d),
                "nearest_attacker_support_dist": second(a), "mean_three_nearest_defender_dist": mean(far(d)[:3], C.FAR_M),
                "defenders_within_10m_of_ball": sum(v <= 10 for v in far(d)),
            }
            assert {n: got[i][side][n] for n in want} == pytest.approx(want, abs=1e-9), (i, side)


def test_boosting_goes_on_while_it_gains(spark):
    from touchline.operators import models

    falling = [1.0 - 0.001 * i for i in range(60)]
    assert models.best_iteration(falling, 20) == (60, False)
    assert models.best_iteration([*falling, *[0.95] * 20, 0.1], 20) == (60, True)
    assert models.best_iteration([1.0, *[1.1] * 19, 0.9], 20) == (21, False) and models.best_iteration([], 20) == (0, False)
    # a curve that one tree cannot follow: small gains go on for longer than ten trees
    rows = spark.range(1500).selectExpr("0L AS match_id", "id AS row_no", "id / 1500D AS x", "id * 7919 % 1500 / 1500D AS z").selectExpr(
        "*", "cast(sin(9 * x) + sin(11 * z) > 0.3 AS int) AS label")
    model = models.fit_boosted(rows, ["x", "z"], iterations=14, patience=7)
    assert model.stages[-1].getNumTrees == 14
