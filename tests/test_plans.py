"""Segmented scans, anchored groups and quantiles against row-by-row definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.plans import quantiles, segments
from touchline.plans.anchored import anchored_groups
from touchline.plans.segments import SEG

# one key holds most rows, segments are far smaller than the key
WIDTH = 8


def _rows(n=400, seed=1, sparse=0.2):
    r = random.Random(seed)
    out, at = [], {0: 0, 1: 0, 2: 0}
    for _ in range(n):
        k = 0 if r.random() < 0.8 else r.choice([1, 2])
        at[k] += r.choice([1, 1, 1, 2, 30])
        out.append((k, at[k], r.choice(["a", "b"]) if r.random() > sparse else None, r.randint(0, 9)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, o bigint, tag string, v bigint").repartition(5)
    return rows, df.withColumn(SEG, segments.segment_of(F.col("o"), WIDTH))


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_number_rows(table):
    rows, df = table
    got = {(r["k"], r["o"]): (r["n"], r["total"]) for r in segments.number_rows(df, ["k"], [SEG], ["o"], name="n", total="total").collect()}
    want = {(r[0], r[1]): (i + 1, len(g)) for g in _by_key(rows).values() for i, r in enumerate(g)}
    assert got == want


def test_number_rows_with_two_bucket_levels(table):
    rows, df = table
    coarse = df.withColumn("c", F.floor(F.col("o") / 64))
    got = {(r["k"], r["o"]): r["n"] for r in segments.number_rows(coarse, ["k"], ["c", SEG], ["o"], name="n").collect()}
    assert got == {(r[0], r[1]): i + 1 for g in _by_key(rows).values() for i, r in enumerate(g)}


def test_previous_last_known_sum_max(table):
    rows, df = table
    prev = {(r["k"], r["o"]): r["p"] for r in segments.previous(df, ["k"], ["o"], {"p": "tag"}).collect()}
    known = {(r["k"], r["o"]): r["x"] for r in segments.last_known(df, ["k"], ["o"], {"x": F.col("tag")}).collect()}
    total = {(r["k"], r["o"]): r["s"] for r in segments.running_sum(df, ["k"], ["o"], {"s": F.col("v")}).collect()}
    top = {(r["k"], r["o"]): r["m"] for r in segments.running_max(df, ["k"], ["o"], {"m": F.col("v")}).collect()}
    for g in _by_key(rows).values():
        last, s, m, before = None, 0, None, None
        for r in g:
            key = (r[0], r[1])
            assert prev[key] == before and top[key] == m
            last, s = (r[2] if r[2] is not None else last), s + r[3]
            assert known[key] == last and total[key] == s
            m, before = (r[3] if m is None else max(m, r[3])), r[2]


@pytest.mark.parametrize("own", [True, False])
def test_count_since(table, own):
    rows, df = table
    out = segments.count_since(df, ["k"], ["o"], F.col("v") == 0, "c", count_reset=own)
    got = {(r["k"], r["o"]): r["c"] for r in out.collect()}
    for g in _by_key(rows).values():
        c = 0
        for r in g:
            c = (1 if own else 0) if r[3] == 0 else c + 1
            assert got[(r[0], r[1])] == c


@pytest.mark.parametrize("gap", [0.0, 1.0, 2.0, 30.0])
def test_islands(table, gap):
    rows, df = table
    tagged = df.withColumn("t", F.col("o").cast("double")).withColumn("g", F.coalesce("tag", F.lit("x"))).drop(SEG)
    got = {(r["k"], r["o"]): r["i"] for r in segments.islands(tagged, ["k"], "t", "t", gap, "i", tag="g", width=WIDTH + gap).collect()}
    for g in _by_key(rows).values():
        start, before = None, None
        for r in g:
            tag = r[2] or "x"
            if before is None or r[1] - before[0] > gap or tag != before[1]:
                start = float(r[1])
            assert got[(r[0], r[1])] == start
            before = (r[1], tag)


def _fold(times, tags, gap):
    anchors, open_ = [], None
    for t, tag in zip(times, tags):
        if open_ is None or open_[1] != tag or t - open_[0] > gap:
            open_ = (t, tag)
        anchors.append(open_[0])
    return anchors


@pytest.mark.parametrize("seed,tagged,dense", [(1, False, True), (2, True, True), (3, False, False), (4, True, False)])
def test_anchored_groups_across_blocks(spark, seed, tagged, dense):
    r = random.Random(seed)
    rows = []
    for k in (0, 1):
        t = 0.0
        for i in range(300 if k == 0 else 40):
            t += r.choice([0.04, 0.5, 1.0, 3.0] if dense else [0.5, 4.0, 11.0, 90.0])
            rows.append((k, round(t, 2), i, r.choice("ab" if tagged else "a")))
    df = spark.createDataFrame(rows, "k int, t double, i bigint, tag string").repartition(3)
    # a block is barely longer than the gap and two blocks make a group, so all levels carry anchors
    out = anchored_groups(df, ["k"], "t", "i", 10.0, tag="tag" if tagged else None, block_s=12.0, fanout=2).collect()
    got = {(r["k"], r["i"]): (r["anchor_s"], r["opens_group"]) for r in out}
    for k in (0, 1):
        mine = [x for x in rows if x[0] == k]
        want = _fold([x[1] for x in mine], [x[3] for x in mine], 10.0)
        assert [got[(k, x[2])][0] for x in mine] == want
        assert [got[(k, x[2])][1] for x in mine] == [x[1] == a for x, a in zip(mine, want)]


def test_anchored_blocks_are_dealt_out_and_summarised_once(spark):
    df = spark.createDataFrame([(0, float(i), i) for i in range(50)], "k int, t double, i bigint")
    plan = anchored_groups(df, ["k"], "t", "i", 10.0, block_s=12.0)._jdf.queryExecution().optimizedPlan().toString()
    # dealt out by number, which adaptive execution leaves alone; only the labels read the rows here, the summaries are a stage table
    assert plan.count("RepartitionByExpression") == 1


def test_exact_quantiles(spark):
    r = random.Random(5)
    values = [(0, r.choice([1.0, 1.0, 2.5, r.random() * 100])) for _ in range(501)] + [(1, 7.0)]
    df = spark.createDataFrame(values, "k int, v double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    got = {x["k"]: x["quantiles"] for x in quantiles.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert np.allclose(got[0], np.quantile([v for k, v in values if k == 0], probs))
    assert got[1] == [7.0] * 6


def test_halo_must_fit(spark):
    with pytest.raises(ValueError):
        segments.with_halo(spark.range(3), "id", 4, 5)


def test_slices_of_heavy_tails_are_balanced(spark):
    import random

    from touchline.plans import slices

    r = random.Random(2)
    rows = [(k, float(r.lognormvariate(0, 4)), i) for k in (0, 1) for i in range(8000)] + [(0, 1.0, 10_000 + i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, v double, i long")
    cut = slices.sliced(df, ["k"], "v", "s", tie="i", tie_width=100, slices=64).cache()
    for k in (0, 1):
        sizes = [x["count"] for x in cut.filter(f"k = {k}").groupBy("s", "s_tie").count().collect()]
        assert max(sizes) <= 4 * sum(sizes) / 64
        last = [x["s"] for x in cut.filter(f"k = {k}").orderBy("v").collect()]
        assert last == sorted(last)  # slices keep the order of the values
    # equal-width slices of the same values
    assert max(x["count"] for x in df.filter("k = 1").groupBy(F.floor(F.col("v") / df.agg(F.max("v")).first()[0] * 64)).count().collect()) > 4 * 8000 / 64


def test_quantiles_and_ranks_of_heavy_tails(spark):
    import random

    import numpy as np

    from touchline.operators.evaluation import ranks
    from touchline.plans.quantiles import exact_quantiles

    r = random.Random(3)
    rows = [(k, r.choice([1.0, -0.0, 0.0, 5e-324, float(r.lognormvariate(0, 5))]), i) for k in (0, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v double, i long")
    for x in exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        assert np.allclose(x["quantiles"], np.quantile([v for k, v, _ in rows if k == x["k"]], [0.0, 0.1, 0.5, 0.99, 1.0]), rtol=1e-12)
    got = {(x["k"], x["i"]): x["n"] for x in ranks(df, ["k"], {"n": "v"}, ["i"]).collect()}
    for k in (0, 1):
        order = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))
        assert [got[k, x[2]] for x in order] == list(range(1, 3001))


def test_windows_gathered_in_blocks_equal_window_rows(spark, sf):
    from touchline import constants as C
    from touchline.catalog import tables as T
    from touchline.operators import features, labels, windows
    from touchline.session import stage
    from touchline.sources import star_tables as S

    context = stage(T.context(spark, sf, True).filter("match_id = 1"))
    samples = stage(labels.build_labels(context.drop("players"), S.orientation(spark))[0])
    table = stage(features.match_features(context, S.orientation(spark)))
    place = C.FEATURES.index("ball_x")
    want = {r["row_no"]: r["x"] for r in windows.window_rows(table, samples).groupBy("row_no").agg(F.sum(F.col("step") * F.col("ball_x")).alias("x")).collect()}
    for width in (130, 4096):
        got = windows.measured_windows(table, samples, lambda x: {"x": (x[:, :, place] * np.arange(x.shape[1])).sum(axis=1)}, "x double", width=width).collect()
        assert {r["row_no"]: pytest.approx(r["x"]) for r in got} == want and len(got) == len(want)


def test_quantile_of_many_partitions_reads_one_sketch(spark):
    n = 200_000
    df = spark.range(n, numPartitions=48).selectExpr("id % 4 AS k", "(id * 7919 % 200000) * 0.5D AS v")
    want = {k: float(np.quantile(np.arange(k, n, 4) * 7919 % n * 0.5, 0.8)) for k in range(4)}
    cut = quantiles.exact_quantiles(df, ["k"], "v", [0.8])
    assert {r["k"]: r["quantiles"][0] for r in cut.collect()} == want
    # slices that a scan reads twice come from one sketch: merging it again in another order gives other splitters
    assert "percentile_approx" not in cut._jdf.queryExecution().toString()


def test_windows_in_the_blocks_of_the_features(spark):
    from touchline import constants as C
    from touchline.catalog import tables as T
    from touchline.operators import features, labels, windows
    from touchline.session import stage
    from touchline.sources import star_tables as S

    context = stage(T.sourced_context(spark, "/root/testdata/sf0.01").filter("match_id = 1"))
    samples = stage(labels.build_labels(context, S.orientation(spark))[0])
    table = stage(features.match_features(context.withColumn("players", F.expr(S.PLAYERS)), S.orientation(spark)))
    measure = lambda x: {"x": (x * np.arange(x.shape[1])[:, None]).sum(axis=(1, 2))}
    want = {r["row_no"]: r["x"] for r in windows.measured_windows(table, samples, measure, "x double").collect()}
    blocks = features.match_features(context, S.orientation(spark), width=3200, players=S.PLAYERS, back=C.OBSERVATION_FRAMES - 1)
    met = windows.measured_windows(blocks, samples, measure, "x double", width=3200)
    got = {r["row_no"]: r["x"] for r in met.collect()}
    assert len(want) == samples.count() and got == want
    plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # frames meet once, as slim rows: neither the features nor the players are shuffled
    assert "space_ahead_of_ball" in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "space_ahead_of_ball" in line]
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_blk" in line]) == 2
