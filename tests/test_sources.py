"""File formats, good and bad."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from touchline.operators import features, orientation, quality
from touchline.sources import epts, events_csv, manifest, tracking_csv
from touchline.sources.text_order import index_frames

HEAD = ",,,Home,,Home,,\n,,,11,,1,,\nPeriod,Frame,Time [s],Player11,,Player1,,Ball,\n"


def _file(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_tracking_csv_values_blanks_and_short_rows(spark, tmp_path):
    p = _file(tmp_path, "h.csv", HEAD + "1,1,0.04,0.4,0.4,NaN,,0.5,0.5\n1,2,0.08,0.5,0.5\n1,3,0.12,x,0.1,0,0,0.5,nan\n")
    rows = tracking_csv.read_team(spark, p, "home", "m").orderBy("frame").collect()
    first = {q["player_id"]: q for q in rows[0]["players"]}
    assert first["home_11"]["x"] == pytest.approx(-10.5) and first["home_11"]["y"] == pytest.approx(6.8)
    assert first["home_1"]["x"] is None and rows[0]["ball_u"] == 0.5
    assert rows[1]["players"][1]["x"] is None and rows[1]["ball_u"] is None
    assert rows[2]["players"][0]["x"] is None and rows[2]["players"][1]["x"] == pytest.approx(-52.5) and rows[2]["ball_v"] is None


@pytest.mark.parametrize("text,reason", [
    (HEAD.replace("Ball", "Ref") + "1,1,0.04,0,0,0,0,0,0\n", "must be the ball"),
    (HEAD.replace("Period", "P") + "1,1,0.04,0,0,0,0,0,0\n", "third header row"),
    (HEAD + "1,1\n", "fewer than 3 columns"),
])
def test_tracking_csv_refuses(spark, tmp_path, text, reason):
    with pytest.raises(Exception, match=reason):
        tracking_csv.read_team(spark, _file(tmp_path, "bad.csv", text), "home", "m").collect()


def test_match_pair_and_agreement(spark, tmp_path):
    h = _file(tmp_path, "h.csv", HEAD + "1,1,0.04,0.4,0.4,0.2,0.2,0.5,0.5\n1,2,0.08,0.4,0.4,0.2,0.2,0.6,0.5\n")
    a = _file(tmp_path, "a.csv", HEAD.replace("Home", "Away") + "1,1,0.04,0.4,0.4,0.2,0.2,0.5,0.5\n1,2,0.08,0.4,0.4,0.2,0.2,0.7,0.5\n")
    m = tracking_csv.read_match(spark, h, a, "m").orderBy("frame").collect()
    assert [r["row_no"] for r in m] == [1, 2] and len(m[0]["players"]) == 4 and m[1]["ball_x"] == pytest.approx(10.5)
    ball = lambda p, t: tracking_csv.ball_of(tracking_csv.read_team(spark, p, t, "m"))
    got = quality.files_agree(ball(h, "home"), ball(a, "away")).first()
    assert not got["agree"] and got["max_ball_difference"] == pytest.approx(0.1)


def test_events_csv(spark, tmp_path):
    head = "Team,Type,Subtype,Period,Start Frame,Start Time [s],End Frame,End Time [s],From,To,Start X,Start Y,End X,End Y\n"
    p = _file(tmp_path, "e.csv", head + "Home,PASS,,1,1,0.04,3,0.12,Player1,Player2,0.4,0.4,0.6,0.6\nAway, ball lost ,x,1,9,0.36,0,,,,0,0,,\n,CARD,,1,5,0.2,,,,,,,,\nhome,Weird,,2,7,0.28,4,0.1,,,NaN,0.1,0.2,0.2\n")
    e = events_csv.read_events(spark, p, "m").orderBy("event_seq").collect()
    assert [(r["team"], r["type"], r["start_frame"], r["end_frame"]) for r in e] == [
        ("home", "pass", 1, 3), ("away", "ball_lost", 9, 9), ("home", "other", 7, 7)]
    assert e[0]["start_x"] == pytest.approx(-10.5) and e[1]["start_x"] == pytest.approx(-52.5) and e[1]["end_x"] is None
    assert e[2]["start_x"] is None and e[2]["end_time_s"] == 0.28 and e[0]["from_player"] == "Player1"
    with pytest.raises(ValueError, match="missing columns"):
        events_csv.read_events(spark, _file(tmp_path, "f.csv", "Team,Type\nHome,PASS\n"), "m")


def _xml(rate="25.0", refs="C0x C0y C1x C1y", span=' startFrame="1" endFrame="1000"', teams=2, periods=True):
    param = lambda n, v: f"<ProviderParameters><ProviderParameter><Name>{n}</Name><Value>{v}</Value></ProviderParameter></ProviderParameters>"
    t = "".join(f'<Team id="T{i}">{param("attack_direction_first_half", "left_to_right" if i == 0 else "right_to_left")}</Team>' for i in range(teams))
    pl = "".join(f'<Player id="P{i}" teamId="T{i}"><ShirtNumber>{i + 1}</ShirtNumber>{param("position_type", "Goalkeeper" if i == 0 else "Defender")}</Player>' for i in (0, 1))
    ch = "".join(f'<PlayerChannel id="C{i}{a}" playerId="P{i}"/>' for i in (0, 1) for a in "xy")
    rf = "".join(f'<PlayerChannelRef playerChannelId="{r}"/>' for r in refs.split())
    halves = "".join(f"<ProviderParameter><Name>{n}</Name><Value>{v}</Value></ProviderParameter>" for n, v in (
        ("first_half_start", 1), ("first_half_end", 500), ("second_half_start", 600), ("second_half_end", 1000))) if periods else ""
    fr = f"<FrameRate>{rate}</FrameRate>" if rate else ""
    return (f"<Metadata><GlobalConfig>{fr}<ProviderParameters>{halves}</ProviderParameters></GlobalConfig><Teams>{t}</Teams><Players>{pl}</Players>"
            f"<PlayerChannels>{ch}</PlayerChannels><DataFormatSpecification{span}>{rf}</DataFormatSpecification></Metadata>")


def test_epts_metadata_tracking_and_direction(spark, tmp_path):
    meta = epts.read_metadata(spark, _file(tmp_path, "m.xml", _xml()), "m")
    r = meta.first()
    assert r["frame_rate"] == 25.0 and r["home_sign"] == 1 and r["away_sign"] == -1
    assert r["layouts"][0]["player_ids"] == ["P0", "P1"]
    keeper = {p["player_id"]: p for p in epts.players(meta).collect()}
    assert keeper["P0"]["is_goalkeeper"] and keeper["P0"]["goalkeeper_source"] == "declared" and keeper["P1"]["team"] == "away"
    d = orientation.declared_directions(epts.declared_first_half(meta), epts.periods(meta))
    assert {(x["period"], x["team"]): x["sign"] for x in d.collect()} == {(1, "home"): 1, (2, "home"): -1, (1, "away"): -1, (2, "away"): 1}
    lines = "1:0.5,0.5;NaN,NaN:0.5,0.5\n\n550:0.1,0.1;0.2,0.2:0.5,0.5\n600:0,0;bad,0.2:NaN,NaN\n"
    f = epts.read_tracking(spark, _file(tmp_path, "t.txt", lines), meta, "m").orderBy("frame").collect()
    assert [(x["frame"], x["period"], x["time_s"]) for x in f] == [(1, 1, 0.04), (600, 2, 24.0)]
    assert f[0]["players"][0]["x"] == 0.0 and f[0]["players"][1]["x"] is None and f[1]["players"][0]["x"] == -52.5
    assert f[1]["players"][1]["x"] is None and f[1]["ball_x"] is None


@pytest.mark.parametrize("kw,reason", [
    (dict(refs="C0x C0y C1x"), "come in pairs"), (dict(refs="C9x C0y"), "unresolved"), (dict(span=""), "frame range"),
    (dict(teams=1), "exactly 2 teams"), (dict(periods=False), "no period"), (dict(rate=""), "no FrameRate"), (dict(refs=""), "no DataFormat"),
])
def test_epts_metadata_refuses(spark, tmp_path, kw, reason):
    with pytest.raises(Exception, match=reason):
        epts.read_metadata(spark, _file(tmp_path, "m.xml", _xml(**kw)), "m").collect()


@pytest.mark.parametrize("line,reason", [("1:0,0;0,0", "without three fields"), ("1:0,0:0,0", "channel count"), ("700:0,0;0,0:0,0", "covered by no layout")])
def test_epts_tracking_refuses(spark, tmp_path, line, reason):
    meta = epts.read_metadata(spark, _file(tmp_path, "m.xml", _xml(span=' startFrame="1" endFrame="650"')), "m")
    with pytest.raises(Exception, match=reason):
        epts.read_tracking(spark, _file(tmp_path, "t.txt", line + "\n"), meta, "m").collect()


def test_events_json(spark, tmp_path):
    data = {"data": [
        {"team": {"id": "T0"}, "type": {"name": "Pass"}, "subtypes": [{"name": "HEAD"}, {"name": ""}, {"name": "CROSS"}], "period": 1,
         "start": {"frame": 5, "time": 0.2, "x": 0, "y": 0.5}, "end": {"frame": 0, "time": None, "x": None, "y": 0.1}, "from": {"id": "P0"}, "to": None},
        {"team": {"id": "T1"}, "type": {"name": "BALL OUT"}, "subtypes": {"name": "A"}, "period": 0, "start": {"frame": 9, "time": 0.36}, "end": {"frame": 12, "time": 0.5}},
        {"team": {"id": "X"}, "type": {"name": "PASS"}, "subtypes": None, "period": 1, "start": {}, "end": {}},
    ]}
    meta = epts.read_metadata(spark, _file(tmp_path, "m.xml", _xml()), "m")
    e = epts.read_events(spark, _file(tmp_path, "e.json", json.dumps(data)), meta, "m").orderBy("event_seq").collect()
    assert [(r["team"], r["type"], r["subtype"], r["start_frame"], r["end_frame"], r["period"]) for r in e] == [
        ("home", "pass", "HEAD-CROSS", 5, 5, 1), ("away", "ball_out", "A", 9, 12, 1)]
    assert e[0]["start_x"] == -52.5 and e[0]["end_x"] is None and e[0]["end_time_s"] == 0.2 and e[0]["from_player"] == "P0"
    with pytest.raises(Exception, match="data list"):
        epts.read_events(spark, _file(tmp_path, "f.json", "{}"), meta, "m").collect()


def test_epts_refuses_a_match_without_metadata(spark, tmp_path):
    meta = epts.read_metadata(spark, _file(tmp_path, "m.xml", _xml()), "m")
    with pytest.raises(Exception, match="no metadata"):
        epts.read_tracking(spark, _file(tmp_path, "t.txt", "1:0,0;0,0:0,0\n"), meta, "other").collect()
    event = {"data": [{"team": {"id": "T0"}, "type": {"name": "PASS"}, "period": 1, "start": {"frame": 5}, "end": {}}]}
    with pytest.raises(Exception, match="no metadata"):
        epts.read_events(spark, _file(tmp_path, "e.json", json.dumps(event)), meta, "other").collect()


def test_goalkeeper_ties_go_by_shirt(spark):
    means = spark.createDataFrame([("m", 1, "home", p, x) for p, x in (("home_10", -40.0), ("home_2", 40.0), ("home_3", 1.0))], "match_id string, period int, team string, player_id string, mean_x double")
    squad = spark.createDataFrame([("m", "home", f"home_{n}", n, False) for n in (10, 2, 3)], "match_id string, team string, player_id string, shirt_number int, is_goalkeeper boolean")
    assert [r["player_id"] for r in orientation.goalkeepers(means, squad).collect()] == ["home_2"]


def test_manifest(spark, tmp_path):
    (tmp_path / "m1").mkdir()
    for n in ("a.csv", "b.csv"):
        (tmp_path / "m1" / n).write_text(n)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("m1", "home", "m1/a.csv", sha("a.csv")), ("m1", "away", "m1/b.csv", sha("other")), ("m1", "events", "m1/c.csv", sha("c"))]
    table = spark.createDataFrame(rows, "match_id string, key string, path string, sha256 string")
    checked = manifest.check_manifest(table, manifest.hash_files(spark, str(tmp_path)))
    assert {r["key"]: r["status"] for r in checked.collect()} == {"home": "ok", "away": "changed", "events": "missing"}
    with pytest.raises(ValueError, match="changed"):
        manifest.require_manifest(checked)
    want = hashlib.sha256("|".join(sorted(f"{m}:{k}:{s}" for m, k, _, s in rows)).encode()).hexdigest()[:16]
    assert manifest.fingerprint(table).first()["fingerprint"] == want


def test_prepare_dataset_end_to_end(spark, sf, tmp_path):
    from touchline.sources import prepared
    from touchline.sources import star_tables as S

    overrides = S.orientation(spark).withColumn("reason", F.lit("set for the test"))
    out = prepared.prepare_dataset(S.frames(spark, sf, True), S.events(spark, sf), S.players(spark, False), str(tmp_path / "p"), overrides=overrides)
    f = prepared.load_prepared(spark, out["features"], [1])
    assert f.select("match_id").distinct().count() == 1 and f.count() == 2 * S.frames(spark, sf).filter("match_id = 1").count()
    assert spark.read.json(out["summary"]).first()["feature_schema"] == "37eda41cef0a592c"


def test_unpacked_players_are_made_once(spark):
    made = "transform(sequence(1, id + 1), i -> named_struct('team', 'home', 'player_id', string(i), 'x', i * 1D, 'y', 0D)) AS players"
    rows = features.unpack_players(spark.range(3).selectExpr("0 AS match_id", "1 AS period", "id AS frame", made))
    assert rows.count() == 6
    # no filter on the array, which would make it again
    assert "size(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_frames_of_both_halves_are_numbered_from_one_window(spark):
    frames = spark.createDataFrame([(m, 1 + (f > 7), f) for m in (1, 2) for f in range(3, 16)], "match_id int, period int, frame bigint")
    got = index_frames(frames.repartition(3), width=4)
    want = [(m, f, f - 2, f - 2 if f <= 7 else f - 7) for m in (1, 2) for f in range(3, 16)]
    assert sorted((r["match_id"], r["frame"], r["row_no"], r["period_row"]) for r in got.collect()) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1


def test_prepare_dataset_makes_players_behind_the_shuffles(spark, sf, tmp_path, monkeypatch):
    from touchline import constants as C
    from touchline.session import stage
    from touchline.sources import prepared
    from touchline.sources import star_tables as S

    overrides = S.orientation(spark).withColumn("reason", F.lit("decided by the table"))
    staged = []
    monkeypatch.setattr(prepared, "stage", lambda df: staged.append(df.columns) or stage(df))
    one = S.frames(spark, sf, source=True).filter("match_id = 1 AND frame <= 400")
    made = prepared.prepare_dataset(one, S.events(spark, sf).filter("match_id = 1"), S.players(spark), str(tmp_path / "a"), overrides=overrides, strict=False, made=S.PLAYERS)
    assert staged and not [c for c in staged if "players" in c]
    carried = prepared.prepare_dataset(one.withColumn("players", F.expr(S.PLAYERS)), S.events(spark, sf).filter("match_id = 1"), S.players(spark), str(tmp_path / "b"), overrides=overrides, strict=False)
    rows = lambda out: sorted(map(tuple, spark.read.parquet(out["features"]).drop("match_id").select("attacking_team", "frame", *C.FEATURES).collect()))
    assert len(rows(made)) == 800 and rows(made) == rows(carried)


def test_lines_of_both_teams_are_shuffled_as_text_and_written_from_columns(spark, sf, tmp_path):
    from touchline.sources import star_tables as S

    frames = S.frames(spark, sf, source=True).filter("match_id = 1 AND frame <= 300")
    for team in ("home", "away"):
        tracking_csv.write_team(frames, str(tmp_path / team), team, [f"{team}_{i}" for i in range(5)], rows_per_file=128, made=S.PLAYERS, compression="gzip")
    read = tracking_csv.read_match(spark, str(tmp_path / "home"), str(tmp_path / "away"), "1")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    # lines meet in blocks of frames: no join by frame, which shuffled arrays of players
    assert "RepartitionByExpression" in plan and "FullOuter" not in plan
    place = lambda p: None if p["x"] is None else (round(p["x"], 1), round(p["y"], 1))
    some = lambda df: {r["frame"]: (r["row_no"], r["period_row"], [place(p) for p in r["players"]]) for r in df.collect()}
    got = some(read)
    assert len(got) == 300 and got == some(frames.withColumn("players", F.expr(S.PLAYERS)))
