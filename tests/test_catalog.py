"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

#: the slow ones (models, full bootstrap) run in the driver's check
FAST = [
    "entries_by_team", "geo_in_box", "geo_goal_angle", "ev_type_map", "insight_facts", "insight_detail", "text_hedged", "win_possession_runs",
    "join_asof_possession", "win_dead_ball_mask", "win_recent_passes", "win_velocity", "win_entry_history", "win_merge_episodes",
    "build_labels", "win_validity", "agg_window_metrics", "agg_average_precision", "agg_calibration", "win_group_alarms",
    "join_alarm_episode", "precision_curve", "editorial_review", "agg_psi", "degrade_stream", "downsample", "win_train_val_split", "feat_ball",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    rel = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    want = sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert rows == want


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
