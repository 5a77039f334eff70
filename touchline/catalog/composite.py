"""Whole jobs: preparing a dataset, evaluating a model, manifests, metadata, reports, scored windows."""

from pyspark.sql import functions as F

from touchline import constants as C
from touchline.catalog import tables as T
from touchline.catalog.analysis import _AP, _EM, _SIGNALS, _inferred
from touchline.catalog.core import _WIN, _measured
from touchline.catalog.live import _MATCH, _epts_metadata, _path
from touchline.catalog.registry import R, query, r6
from touchline.operators import drift, evaluation, features, folds, models, orientation, protocol, windows
from touchline.session import stage
from touchline.sources import manifest, prepared, sinks, tracking_csv
from touchline.sources import star_tables as S
from touchline.sources.text_order import match_from_path


@query("prepare_dataset", """[smp frames] SELECT s.match_id, s.n, s.positives, s.places, e.episodes, e.entries, f.feature_rows FROM
    (SELECT match_id, count(*) AS n, count(*) FILTER (hit) AS positives, sum(row_no)::BIGINT AS places FROM smp GROUP BY 1) s
    LEFT JOIN (SELECT match_id, count(*) AS episodes, sum(n_entries)::BIGINT AS entries FROM eps GROUP BY 1) e USING (match_id) JOIN (SELECT match_id, 2*count(*) AS feature_rows FROM frames GROUP BY 1) f USING (match_id)""")
def prepare_dataset(spark, d):
    """Everything is written by match and read back; directions are decided by hand, as the motion here has none."""
    decided = S.orientation(spark).withColumn("reason", F.lit("decided by the table"))
    out = prepared.prepare_dataset(stage(S.frames(spark, d, source=True)), S.events(spark, d), S.players(spark), _path(spark), overrides=decided, made=S.PLAYERS)
    match = F.col("match_id").cast("bigint").alias("match_id")
    s = prepared.load_prepared(spark, out["samples"]).groupBy(match).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives"), F.sum("row_no").alias("places"))
    e = prepared.load_prepared(spark, out["episodes"]).groupBy(match).agg(F.count(F.lit(1)).alias("episodes"), F.sum("n_entries").cast("bigint").alias("entries"))
    f = prepared.load_prepared(spark, out["features"]).groupBy(match).agg(F.count(F.lit(1)).alias("feature_rows"))
    return s.join(e, "match_id", "left").join(f, "match_id")


@query("sink_prepared", "[smp] SELECT match_id, row_no, CASE WHEN hit THEN 1 ELSE 0 END AS label, cluster_id FROM smp")
def sink_prepared(spark, d):
    """Samples by match, written twice: the second replaces the first."""
    path = _path(spark)
    s = stage(T.samples(spark, d)[0])
    for rows in (s.filter("label = 1"), s):
        rows.write.mode("overwrite").partitionBy("match_id").parquet(path)
    return prepared.load_prepared(spark, path).select(F.col("match_id").cast("bigint").alias("match_id"), "row_no", F.col("label").cast("int").alias("label"), "cluster_id")


@query("evaluate", f"""[w eps] AND {_EM}, {_AP}, wm AS (SELECT match_id, count(*) AS n, count(*) FILTER (probability>=0.8::DOUBLE AND label=1) AS tp, count(*) FILTER (probability>=0.8::DOUBLE AND label=0) AS fp, count(*) FILTER (probability<0.8::DOUBLE AND label=1) AS fn,
      {R('avg((probability-label)*(probability-label))')} AS brier FROM w GROUP BY 1), cb AS (SELECT match_id, count(DISTINCT least(floor(probability*10+1e-9::DOUBLE),9)) AS bins FROM w GROUP BY 1)
    SELECT match_id, n, tp, fp, fn, brier, {R('pr_auc')} AS pr_auc, episodes, alarms, detected, early_alarms, {R('(alarms-detected)/minutes*90')} AS false_alarms_per_90, {R('q2')} AS median_warning_s, bins FROM x JOIN ap USING (match_id) JOIN wm USING (match_id) JOIN cb USING (match_id)""")
def evaluate(spark, d):
    """Windows, episodes and calibration of one scored set in one report."""
    report = protocol.evaluate(S.windows(spark, d), T.window_episodes(spark, d), 0.8, bootstrap=False)
    bins = report["calibration"].groupBy("match_id").agg(F.count(F.lit(1)).alias("bins"))
    row = report["window"].select("match_id", "n", "tp", "fp", "fn", r6("brier").alias("brier"), r6("pr_auc").alias("pr_auc"))
    episode = report["episode"].select("match_id", "episodes", "alarms", "detected", "early_alarms", r6("false_alarms_per_90").alias("false_alarms_per_90"), r6("median_warning_s").alias("median_warning_s"))
    return row.join(episode, "match_id").join(bins, "match_id")


@query("chk_manifest", """SELECT s_nationkey::BIGINT AS match_id, s_name AS key, sha256(s_name || chr(10)) AS sha256, CASE WHEN s_suppkey % 7 = 0 THEN 'missing' WHEN s_suppkey % 5 = 0 THEN 'changed' ELSE 'ok' END AS status FROM supplier""")
def chk_manifest(spark, d):
    """A file a supplier: recorded with its hash, every 7th gone and every 5th rewritten since."""
    path = _path(spark)
    s = S.read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    # one task a folder's file: the recorded hashes are those of whole files
    s.repartition(8, "s_suppkey").select("s_suppkey", F.col("s_name").alias("value")).write.partitionBy("s_suppkey").text(path)
    found = stage(manifest.hash_files(spark, path, "*.txt"))
    key = F.regexp_extract("path", r"s_suppkey=(\d+)/", 1).cast("bigint")
    recorded = found.select(key.alias("s_suppkey"), F.element_at(F.split("path", "/"), -1).alias("file"), "sha256").join(s, "s_suppkey").select(
        F.col("s_nationkey").cast("bigint").alias("match_id"), F.col("s_name").alias("key"), F.concat(F.lit("s_suppkey="), "s_suppkey", F.lit("/"), "file").alias("path"), "sha256")
    now = found.withColumn("_k", key).filter("_k % 7 <> 0").withColumn("sha256", F.when(F.col("_k") % 5 == 0, F.sha2(F.concat("sha256", F.lit("new")).cast("binary"), 256)).otherwise(F.col("sha256"))).drop("_k")
    return manifest.check_manifest(recorded, now).select("match_id", "key", "sha256", "status")


@query("src_metadata_xml", """[msz] SELECT match_id, 25::DOUBLE AS frame_rate, 10::BIGINT AS players, 2::BIGINT AS layouts, 1::BIGINT AS first_start, n//2 AS first_end, n//2+1 AS second_start, n AS second_end, 'home_0' AS first_of_first, 'away_4' AS first_of_second FROM msz""")
def src_metadata_xml(spark, d):
    m = _epts_metadata(spark, d)
    half = lambda i, c: F.col("periods")[i][c].alias(f"{('first', 'second')[i]}_{c.split('_')[0]}")
    return m.select(F.col("match_id").cast("bigint").alias("match_id"), "frame_rate", F.size("squad").cast("bigint").alias("players"), F.size("layouts").cast("bigint").alias("layouts"),
                    half(0, "start_frame"), half(0, "end_frame"), half(1, "start_frame"), half(1, "end_frame"), F.col("layouts")[0]["player_ids"][0].alias("first_of_first"), F.col("layouts")[1]["player_ids"][0].alias("first_of_second"))


@query("sink_csv_layout", "[frames pos] SELECT p.match_id, p.frame, round(f.ball_x/105::DOUBLE+0.5::DOUBLE, 5)+0 AS ball_u, count(p.x) AS present, count(*) AS slots FROM frames f JOIN pos p USING (match_id, period, frame) WHERE p.team='home' GROUP BY ALL")
def sink_csv_layout(spark, d):
    base = _path(spark)
    f = stage(S.frames(spark, d, True))
    tracking_csv.write_team(f, f"{base}/home", "home", [f"{t}_{s}" for t, s, _, _ in S.SLOTS if t == "home"])
    r = tracking_csv.read_team(spark, f"{base}/home", "home", match_from_path(_MATCH))
    return r.select(F.col("match_id").cast("bigint").alias("match_id"), "frame", (F.round("ball_u", 5) + F.lit(0.0)).alias("ball_u"),
                    F.size(F.filter("players", lambda p: p["x"].isNotNull())).cast("bigint").alias("present"), F.size("players").cast("bigint").alias("slots"))


@query("sink_direction_report", _SIGNALS + f"SELECT dv.match_id, dv.period, dv.team, dv.sign, {R('agreement')} AS agreement, s.signals FROM dv JOIN (SELECT match_id, period, team, count(*) AS signals FROM sg GROUP BY 1,2,3) s USING (match_id, period, team)")
def sink_direction_report(spark, d):
    """Votes with their evidence nested, through the JSON report."""
    path = _path(spark)
    means, keepers = _inferred(spark, d)
    v = orientation.direction_vote(orientation.direction_signals(means, S.events(spark, d), keepers))
    sinks.write_report(v, path)
    r = spark.read.schema(v.schema).json(path)
    return r.select("match_id", "period", "team", "sign", r6("agreement").alias("agreement"), F.size("signals").cast("bigint").alias("signals"))


@query("sink_drift_report", """[w] AND q AS (SELECT unnest(list_distinct(quantile_cont(probability, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS e FROM w WHERE match_id<2),
    b AS (SELECT w.match_id<2 AS ref, w.row_no, w.match_id, (SELECT count(*) FROM q WHERE e<=w.probability) AS bin FROM w), h AS (SELECT bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS t FROM b GROUP BY 1),
    s AS (SELECT bin, greatest(r/(SELECT sum(r) FROM h)::DOUBLE, 1e-6::DOUBLE) AS a, greatest(t/(SELECT sum(t) FROM h)::DOUBLE, 1e-6::DOUBLE) AS c FROM h)
    SELECT 'psi_model_confidence' AS name, 'confidence_drift' AS category, round(sum((c-a)*ln(c/a)),6) AS value, sum((c-a)*ln(c/a))>0.2::DOUBLE AS violation FROM s""")
def sink_drift_report(spark, d):
    path = _path(spark)
    w = stage(S.windows(spark, d))
    sinks.write_report(drift.confidence_drift(w.filter("match_id < 2"), w.filter("match_id >= 2")), path)
    r = spark.read.schema("name string, category string, value double, threshold double, violation boolean").json(path)
    return r.select("name", "category", F.round("value", 6).alias("value"), "violation")


@query("sink_cv_report", f"""[w eps] AND {_EM}, {_AP} SELECT match_id AS held_out, round(pr_auc,4) AS pr_auc, round(detected::DOUBLE/alarms,4) AS precision, round(detected::DOUBLE/episodes,4) AS recall FROM x JOIN ap USING (match_id)""")
def sink_cv_report(spark, d):
    """Per-fold lists of the rule score, through the JSON report and unnested again."""
    path = _path(spark)
    w = stage(S.windows(spark, d))
    em = evaluation.episode_metrics(stage(T.alarms(spark, d)), stage(T.window_episodes(spark, d)), evaluation.match_spans(w))
    folds = em.join(evaluation.average_precision(w), "match_id").withColumn("model", F.lit("rule")).withColumnRenamed("match_id", "held_out")
    summary = evaluation.lomo_summary(folds)
    sinks.write_report(summary, path)
    r = spark.read.schema(summary.schema).json(path)
    lists = F.arrays_zip(F.col("folds").alias("held_out"), F.col("window_pr_auc").alias("pr_auc"), F.col("episode_precision").alias("precision"), F.col("episode_recall").alias("recall"))
    return r.select(F.explode(lists).alias("f")).select("f.*")


@query("model_metadata", "[w] SELECT 'rule-'||match_id AS name, '1.0.0' AS version, 'rule' AS kind, false AS is_ml, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS positives FROM w GROUP BY match_id")
def model_metadata(spark, d):
    """The record of each match's rule model, with its metrics; as many as there are models."""
    m = evaluation.window_metrics(S.windows(spark, d), 0.8).collect()
    t = models.models_table(spark, [{"name": f"rule-{r['match_id']}", "kind": "rule", "is_ml": False, "threshold": 0.8, "metrics": {"n": float(r["n"]), "positives": float(r["positives"])}} for r in m])
    return t.select("name", "version", "kind", "is_ml", F.col("metrics")["n"].alias("n"), F.col("metrics")["positives"].alias("positives"))


@query("predict_windows", f"{_WIN} SELECT match_id, frame, round(avg(ball_x::FLOAT::DOUBLE),4)+0 AS probability, round(sum({'+'.join(f'{f}::FLOAT::DOUBLE' for f in C.FEATURES)}),2) AS total, 'mean-x' AS model FROM wr GROUP BY 1, 2")
def predict_windows(spark, d):
    """A scorer of whole windows, called on batches of them inside the block they are gathered in."""
    place = C.FEATURES.index("ball_x")

    def scorer(x):
        x = x.astype("float32").astype("float64")
        return {"probability": x[:, :, place].mean(axis=1), "total": x.sum(axis=(1, 2))}

    p = _measured(spark, d, scorer, "probability double, total double")
    return p.select("match_id", F.col("row_no").alias("frame"), (F.round("probability", 4) + F.lit(0.0)).alias("probability"), F.round("total", 2).alias("total"), F.lit("mean-x").alias("model"))


@query("model_boosted", "[smp] SELECT match_id, count(*) AS n, true AS in_bounds, 'baseline-boosted' AS model FROM smp WHERE match_id = 0 GROUP BY 1")
def model_boosted(spark, d):
    """Boosted trees with early stopping, trained without match 0 and scored on it."""
    summary = _summaries(spark, d)[0]
    fitted = models.fit_boosted(summary.filter("match_id <> 0"))
    p = models.score(fitted, summary.filter("match_id = 0"), "baseline-boosted")
    return p.groupBy("match_id", "model").agg(F.count(F.lit(1)).alias("n"), F.every((F.col("probability") >= 0) & (F.col("probability") <= 1)).alias("in_bounds"))


def _summaries(spark, d):
    """Window summaries of all samples, and the episodes on the same clock."""
    f, s, episodes = T.window_features(spark, d)
    return stage(windows.measured_windows(f, s, windows.summary_of, ", ".join(f"{c} double" for c in models.summary_columns()), width=features.BLOCK)), episodes


def _in_unit(*names):
    """Whether each column lies in 0..1 where it has a value."""
    return F.every(F.expr(" AND ".join(f"coalesce({n} BETWEEN 0 AND 1, true)" for n in names)))


@query("cross_validate", """[smp] SELECT s.match_id AS held_out, 'baseline-logistic' AS model, s.n, s.positives, s.positives AS found_or_missed, e.episodes, true AS in_bounds, 4::BIGINT AS folds, 4::BIGINT AS listed
    FROM (SELECT match_id, count(*) AS n, count(*) FILTER (hit) AS positives FROM smp GROUP BY 1) s LEFT JOIN (SELECT match_id, count(*) AS episodes FROM eps GROUP BY 1) e USING (match_id)""")
def cross_validate(spark, d):
    """Logistic models of all folds trained side by side, every match scored by the model that has not seen it."""
    rows, episodes = _summaries(spark, d)
    scored, metrics, summary = folds.cross_validate(rows.withColumn("fold", F.col("match_id").cast("int")), episodes, models.summary_columns(), S.MATCHES)
    bounds = scored.groupBy("match_id").agg(_in_unit("probability", "threshold").alias("_p")).withColumnRenamed("match_id", "held_out")
    lists = summary.select("model", F.size("folds").cast("bigint").alias("folds"), F.size("episode_recall").cast("bigint").alias("listed"))
    m = metrics.join(bounds, "held_out").join(lists, "model")
    inside = F.expr("_p AND coalesce(pr_auc BETWEEN 0 AND 1, true) AND precision BETWEEN 0 AND 1 AND recall BETWEEN 0 AND 1")
    return m.select("held_out", "model", "n", "positives", (F.col("tp") + F.col("fn")).alias("found_or_missed"), "episodes", inside.alias("in_bounds"), "folds", "listed")


@query("reference_split", "[smp] SELECT DISTINCT match_id AS held_out, 'baseline-logistic' AS model, true AS in_bounds FROM smp WHERE match_id = 0")
def reference_split(spark, d):
    """Match 0 held out, the threshold frozen on the alarms of the others."""
    rows, episodes = _summaries(spark, d)

    def fit(train):
        fitted = models.fit_logistic(train)
        return lambda samples: models.score(fitted, samples, "baseline-logistic")

    r = protocol.reference_split(rows, stage(episodes), {"baseline-logistic": fit}, 0)
    return r.groupBy("held_out", "model").agg(_in_unit("threshold", "pr_auc", "precision", "recall").alias("in_bounds"))
