"""Window metrics, alarms, alarm-to-episode matching, calibration, thresholds, bootstrap.

Everything takes ``keys``: one match, a match and a threshold, or a match and a bootstrap replicate
are the same job with one more grouping column.

Predictions are (keys, row_no, time_s, team, probability, label); episodes are
(keys, team, entry_time_s).
"""

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import constants as C
from touchline.plans import segments
from touchline.plans.quantiles import exact_quantiles
from touchline.plans.segments import SEG
from touchline.plans.slices import sliced
from touchline.session import stage

MATCH = ("match_id",)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def window_counts(predictions: DataFrame, threshold, keys: Sequence[str] = MATCH, weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, n, positives, squared error per key; rows may carry a weight (multiplicity)."""
    w = weight if weight is not None else F.lit(1)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    fires, y = F.col("probability") >= limit, F.col("label")
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0)).cast("bigint")
    return predictions.groupBy(*keys).agg(
        F.sum(w).cast("bigint").alias("n"), total(y == 1).alias("positives"),
        total(fires & (y == 1)).alias("tp"), total(fires & (y == 0)).alias("fp"),
        total(~fires & (y == 1)).alias("fn"),
        F.sum(w * (F.col("probability") - y) * (F.col("probability") - y)).alias("_sq"),
    )


def window_metrics(predictions: DataFrame, threshold, keys: Sequence[str] = MATCH) -> DataFrame:
    """Precision is 0 when nothing fires."""
    c = window_counts(predictions, threshold, keys)
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        *keys, "n", "positives", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"),
        _f1(precision, recall).alias("f1"), (F.col("_sq") / F.col("n")).alias("brier"),
        (F.col("positives") / F.col("n")).alias("base_rate"),
    )


def average_precision(predictions: DataFrame, keys: Sequence[str] = MATCH, weight: Column | None = None) -> DataFrame:
    """Step-wise average precision over distinct scores; NULL unless both classes occur.

    Rows are first reduced to one per distinct score. Distinct scores are then cut into slices of about as many
    each, so not even those of a hot key meet in one task.
    """
    w = weight if weight is not None else F.lit(1)
    return _area(stage(predictions.groupBy(*keys, "probability").agg(
        F.sum(F.when(F.col("label") == 1, w).otherwise(0)).cast("bigint").alias("_tp"),
        F.sum(w).cast("bigint").alias("_n"),
    )), keys)


def _area(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average precision from one row per key and score: ``_tp`` of ``_n`` rows are positive."""
    placed = sliced(scores.withColumn("_down", -F.col("probability")), keys, "_down", SEG)
    ranked = segments.running_sum(placed, list(keys), ["_down"], {"_ctp": F.col("_tp"), "_cn": F.col("_n")})
    out = ranked.groupBy(*keys).agg(
        F.sum(F.col("_tp") * F.col("_ctp") / F.col("_cn")).alias("_area"),
        F.sum("_tp").alias("_pos"), F.sum("_n").alias("_all"),
    )
    both = (F.col("_pos") > 0) & (F.col("_pos") < F.col("_all"))
    return out.select(*keys, F.when(both, F.col("_area") / F.when(F.col("_pos") > 0, F.col("_pos"))).alias("pr_auc"))


def calibration_bins(predictions: DataFrame, keys: Sequence[str] = MATCH, n_bins: int = 10) -> DataFrame:
    """Equal-width reliability bins, the last one closed, empty ones omitted."""
    edges = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
    p = F.col("probability")
    reached = F.size(F.filter(edges, lambda e: e <= p))
    number = F.least(reached, F.lit(n_bins)) - 1
    binned = predictions.filter((p >= 0) & (p <= 1)).withColumn("bin", number.cast("int"))
    return binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_predicted"),
        F.avg("label").alias("observed_rate"),
    ).select(
        *keys, (F.col("bin") / n_bins).alias("bin_lower"), ((F.col("bin") + 1) / n_bins).alias("bin_upper"),
        "n", "mean_predicted", "observed_rate",
    )


def group_alarms(
    firing: DataFrame, keys: Sequence[str] = MATCH, bridge_s: float = C.ALARM_BRIDGE_S, width: float = segments.SEGMENT_S
) -> DataFrame:
    """Alarms from firing windows: a break is a gap over ``bridge_s`` or another team than the
    firing window before. ``n_windows`` also counts the silent windows bridged over."""
    named = segments.islands(firing, list(keys), "time_s", "time_s", bridge_s, "alarm_s", tag="team", tie=["row_no"], width=width)
    # two alarms of one key may start at the same instant only for different teams
    return named.groupBy(*keys, "alarm_s", "team").agg(
        F.max("time_s").alias("end_s"),
        (F.max("row_no") - F.min("row_no") + 1).alias("n_windows"),
        F.max("probability").alias("peak"),
    ).withColumnRenamed("alarm_s", "start_s")


def _cut(on: np.ndarray, t: np.ndarray, team: np.ndarray, bridge_s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alarms of a matrix (windows, variants): variant, first and last window of each, by variant and time."""
    variant, at = np.nonzero(on.T)
    if not len(at):
        return variant, at, at
    first = np.flatnonzero(np.append(True, (np.diff(variant) != 0) | (np.diff(t[at]) > bridge_s) | (team[at][1:] != team[at][:-1])))
    return variant[first], at[first], at[np.append(first[1:], len(at)) - 1]


def variant_alarms(
    windows: DataFrame, fires: Callable[[pd.DataFrame], np.ndarray], number: str, keys: Sequence[str] = MATCH,
    bridge_s: float = C.ALARM_BRIDGE_S, width: float = segments.SEGMENT_S, together: int = 64,
) -> DataFrame:
    """:func:`group_alarms` of many variants of what fires, numbered in ``number``, from one copy of the windows.

    ``fires`` gives, for the windows of a time block, a matrix (windows, variants) of booleans. Alarms are cut in the block,
    ``together`` variants at a time; only alarms leave it, and those of neighbouring blocks that belong together are joined.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in windows.schema}

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["time_s", "row_no"], ignore_index=True)
        t, team, row = (rows[c].to_numpy() for c in ("time_s", "team", "row_no"))
        on, found = fires(rows), []
        for low in range(0, on.shape[1], together):
            variant, a, b = _cut(on[:, low:low + together], t, team, bridge_s)
            found.append(pd.DataFrame({number: variant + low, "team": team[a], "start_s": t[a], "end_s": t[b], "first_row": row[a], "last_row": row[b]}))
        out = pd.concat(found) if found else pd.DataFrame(columns=[number, "team", "start_s", "end_s", "first_row", "last_row"])
        return out.assign(**{k: rows[k].iloc[0] for k in keys})[[*keys, number, "team", "start_s", "end_s", "first_row", "last_row"]]

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{number} int", f"team {types['team']}", "start_s double", "end_s double", "first_row long", "last_row long"])
    blocks = windows.withColumn("_blk", segments.segment_of(F.col("time_s"), width)).groupBy(*keys, "_blk").applyInPandas(cut, schema)
    named = segments.islands(blocks, [*keys, number], "start_s", "end_s", bridge_s, "alarm_s", tag="team", tie=["first_row"], width=width)
    return named.groupBy(*keys, number, "alarm_s", "team").agg(
        F.max("end_s").alias("end_s"), (F.max("last_row") - F.min("first_row") + 1).alias("n_windows"),
    ).withColumnRenamed("alarm_s", "start_s")


def _candidates(alarms: DataFrame, episodes: DataFrame, keys: Sequence[str], horizon_s: float) -> DataFrame:
    """Alarm-episode pairs of one team with start <= entry <= end + horizon, met in time buckets.

    Episodes without some of the keys (a threshold, say) hold for every value of those.
    """
    width = 12 * horizon_s
    b = lambda t: F.floor(t / F.lit(width)).cast("bigint")
    spread = alarms.withColumn("_b", F.explode(F.sequence(b(F.col("start_s")), b(F.col("end_s") + F.lit(horizon_s)))))
    listed = episodes.withColumn("_b", b(F.col("entry_time_s")))
    entry = F.col("entry_time_s")
    meets = (F.col("start_s") <= entry) & (F.col("end_s") >= entry - F.lit(horizon_s))
    return spread.join(listed, [*(k for k in keys if k in episodes.columns), "team", "_b"]).filter(meets).drop("_b")


def match_alarms(
    alarms: DataFrame, episodes: DataFrame, keys: Sequence[str] = MATCH, horizon_s: float = C.HORIZON_S
) -> DataFrame:
    """Greedy one-to-one matching in alarm order: the first unused episode that meets the alarm.

    Alarms of a team are disjoint and in time order, as are the episodes. Two neighbouring alarms
    compete only if an episode meets both, so alarms are chained where they share one and every
    chain is matched on its own.
    """
    keys = list(keys)
    pairs = _candidates(alarms, episodes, keys, horizon_s)
    per_alarm = pairs.groupBy(*keys, "team", "start_s").agg(F.array_sort(F.collect_list("entry_time_s")).alias("_entries"))
    per_alarm = per_alarm.withColumn("_last", F.array_max("_entries"))
    chained = segments.islands(per_alarm, [*keys, "team"], "start_s", "_last", 0.0, "_chain")
    chains = chained.groupBy(*keys, "team", "_chain").agg(
        F.array_sort(F.collect_list(F.struct("start_s", "_entries"))).alias("_alarms"))
    # walk one chain: the episodes taken so far are a prefix in time, with repeats counted
    start = F.struct(
        F.array().cast("array<struct<start_s:double,entry_time_s:double>>").alias("taken"),
        F.lit(-1.0e300).alias("last"), F.lit(0).alias("used"))

    def step(state, alarm):
        free = F.filter(
            F.transform(alarm["_entries"], lambda e, i: F.struct(
                e.alias("e"),
                (i - F.array_position(alarm["_entries"], e).cast("int") + 1).alias("nth"))),
            lambda c: (c["e"] > state["last"]) | ((c["e"] == state["last"]) & (c["nth"] >= state["used"])))
        pick = F.get(free, F.lit(0))
        took = pick.isNotNull()
        return F.when(took, F.struct(
            F.concat(state["taken"], F.array(F.struct(alarm["start_s"].alias("start_s"), pick["e"].alias("entry_time_s")))).alias("taken"),
            pick["e"].alias("last"),
            F.when(pick["e"] == state["last"], state["used"] + 1).otherwise(1).alias("used"),
        )).otherwise(state)

    walked = chains.select(*keys, "team", F.explode(F.aggregate("_alarms", start, step, lambda s: s["taken"])).alias("_m"))
    return walked.select(*keys, "team", F.col("_m.start_s").alias("start_s"), F.col("_m.entry_time_s").alias("entry_time_s"))


def early_alarms(
    alarms: DataFrame, matched: DataFrame, episodes: DataFrame, keys: Sequence[str] = MATCH, horizon_s: float = C.HORIZON_S
) -> DataFrame:
    """Unmatched alarms followed by an entry of their team within three horizons after their end."""
    keys = list(keys)
    reach = 3 * horizon_s
    unmatched = alarms.join(matched, [*keys, "team", "start_s"], "left_anti")
    b = lambda t: F.floor(t / F.lit(reach)).cast("bigint")
    left = unmatched.withColumn("_b", F.explode(F.array(b(F.col("end_s")), b(F.col("end_s")) + 1)))
    right = episodes.select(*keys, "team", F.col("entry_time_s").alias("_e")).withColumn("_b", b(F.col("_e")))
    follows = (F.col("_e") > F.col("end_s")) & (F.col("_e") - F.col("end_s") <= F.lit(reach))
    same = [left[k] == right[k] for k in [*keys, "team", "_b"]]
    condition = follows
    for c in same:
        condition = condition & c
    return left.join(right, condition, "left_semi").drop("_b").dropDuplicates([*keys, "team", "start_s"])


def episode_metrics(
    alarms: DataFrame, episodes: DataFrame, spans: DataFrame, keys: Sequence[str] = MATCH, horizon_s: float = C.HORIZON_S
) -> DataFrame:
    """Episode-level metrics per key. ``spans(keys, minutes)`` lists every key and its length.

    Early alarms are counted apart and still are false alarms.
    """
    keys = list(keys)
    matched = match_alarms(alarms, episodes, keys, horizon_s)
    warned = matched.withColumn("_warning", F.col("entry_time_s") - F.col("start_s"))
    found = warned.groupBy(*keys).agg(F.count(F.lit(1)).alias("detected"))
    warnings = exact_quantiles(warned, keys, "_warning", [0.25, 0.5, 0.75], "_q")
    raised = alarms.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alarms"), F.percentile("n_windows", 0.5).alias("_per_alarm"))
    early = early_alarms(alarms, matched, episodes, keys, horizon_s).groupBy(*keys).agg(F.count(F.lit(1)).alias("early_alarms"))
    truth = episodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("episodes"))
    out = spans
    for part in (raised, found, warnings, early, truth):
        out = out.join(part, keys, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    precision, recall = _ratio(n("detected"), n("alarms")), _ratio(n("detected"), n("episodes"))
    false = n("alarms") - n("detected")
    return out.select(
        *keys, n("episodes").alias("episodes"), n("alarms").alias("alarms"), n("detected").alias("detected"),
        false.alias("false_alarms"), n("early_alarms").alias("early_alarms"),
        precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"),
        (false / F.greatest(F.col("minutes"), F.lit(1e-9)) * C.MATCH_MINUTES).alias("false_alarms_per_90"),
        F.col("_q")[1].alias("median_warning_s"), F.col("_q")[0].alias("warning_q25_s"), F.col("_q")[2].alias("warning_q75_s"),
        F.coalesce("_per_alarm", F.lit(0.0)).alias("median_windows_per_alarm"),
    )


def match_spans(predictions: DataFrame, keys: Sequence[str] = MATCH) -> DataFrame:
    """Minutes between the first and the last sample, the base of false-alarm rates."""
    return predictions.groupBy(*keys).agg(((F.max("time_s") - F.min("time_s")) / 60.0).alias("minutes"))


# --- thresholds -------------------------------------------------------------------------


def threshold_grid(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def alarm_budget_curves(
    predictions: DataFrame, episodes: DataFrame, models: int, grid: Sequence[float] | None = None,
    horizon_s: float = C.HORIZON_S, bridge_s: float = C.ALARM_BRIDGE_S,
) -> DataFrame:
    """Alarms, detections and the false-alarm rate over all matches, one row per model and threshold.

    ``probabilities`` holds a window's score by each of ``models`` models, NULL where the window is not that model's. Windows are
    shuffled once for all models and thresholds; a match counts for a model that scores windows of it.
    """
    grid = list(grid) if grid is not None else threshold_grid(0.05, 0.98, 94)
    n, limits, keys = len(grid), np.array(grid), ["match_id", "_variant"]

    def fires(rows: pd.DataFrame) -> np.ndarray:
        p = np.array([list(x) for x in rows["probabilities"]], float)
        return (p[:, :, None] >= limits).reshape(len(p), models * n)

    asked = predictions.select("match_id", "row_no", "time_s", "team", "probabilities")
    alarms = stage(variant_alarms(asked.filter(F.exists("probabilities", lambda p: p >= F.lit(min(grid)))), fires, "_variant", bridge_s=bridge_s))
    matched = match_alarms(alarms, episodes, keys, horizon_s)
    raised = alarms.groupBy("_variant").agg(F.count(F.lit(1)).alias("alarms"))
    found = matched.groupBy("_variant").agg(F.count(F.lit(1)).alias("detected"))
    scored = predictions.select("match_id", "time_s", F.posexplode("probabilities").alias("model_no", "_p")).filter("_p IS NOT NULL")
    minutes = match_spans(scored, ["match_id", "model_no"]).groupBy("model_no").agg(F.sum("minutes").alias("minutes"))
    levels = F.explode(F.array(*[
        F.struct(F.lit(i).alias("grid_no"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])).alias("g")
    rows = minutes.select("model_no", "minutes", levels).select("model_no", "minutes", "g.*").withColumn("_variant", F.col("model_no") * n + F.col("grid_no"))
    rows = rows.join(raised, "_variant", "left").join(found, "_variant", "left").fillna(0, ["alarms", "detected"])
    false = F.col("alarms") - F.col("detected")
    return rows.select(
        "model_no", "grid_no", "threshold", "alarms", "detected", false.alias("false_alarms"),
        (false / F.greatest(F.col("minutes"), F.lit(1e-9)) * C.MATCH_MINUTES).alias("false_alarms_per_90"),
    )


def alarm_budget_curve(
    predictions: DataFrame, episodes: DataFrame, grid: Sequence[float] | None = None,
    horizon_s: float = C.HORIZON_S, bridge_s: float = C.ALARM_BRIDGE_S,
) -> DataFrame:
    """:func:`alarm_budget_curves` of the one model that scored ``probability``."""
    one = predictions.withColumn("probabilities", F.array("probability"))
    return alarm_budget_curves(one, episodes, 1, grid, horizon_s, bridge_s).drop("model_no")


def threshold_by_budget(curve: DataFrame, budget: float = C.FALSE_ALARM_BUDGET, keys: Sequence[str] = ()) -> DataFrame:
    """Lowest threshold within the budget that detects something, else the one with the lowest rate."""
    ok = (F.col("false_alarms_per_90") <= budget) & (F.col("detected") > 0)
    return curve.groupBy(*keys).agg(
        F.min(F.when(ok, F.col("threshold"))).alias("_ok"),
        F.min_by("threshold", F.struct("false_alarms_per_90", "grid_no")).alias("_least"),
    ).select(*keys, F.coalesce("_ok", "_least").alias("threshold"), F.col("_ok").isNotNull().alias("within_budget"))


def precision_curve(predictions: DataFrame, grid: Sequence[float] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over all predictions, one row per threshold.

    Scores are reduced to counts per number of thresholds reached; the curve sums those counts.
    """
    grid = list(grid) if grid is not None else threshold_grid(0.05, 0.95, 91)
    limits = F.array(*map(F.lit, grid))
    reached = F.size(F.filter(limits, lambda t: t <= F.col("probability")))
    hist = predictions.groupBy(reached.alias("_r")).agg(
        F.sum(F.col("label")).cast("bigint").alias("_p"), F.sum(1 - F.col("label")).cast("bigint").alias("_q"))
    # one row per threshold count, at most len(grid) + 1 of them
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("grid_no")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    levels = F.explode(F.array(*[
        F.struct(F.lit(i).alias("grid_no"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)]))
    zero = hist.agg(F.count(F.lit(1)).alias("_any")).select(levels.alias("g")).select("g.*")
    # a score reaching r thresholds fires at grid positions 0 .. r-1
    joined = zero.join(hist.withColumn("grid_no", F.col("_r") - 1), "grid_no", "full_outer").fillna(0, ["_p", "_q"])
    summed = joined.select(
        "grid_no", "threshold", F.sum("_p").over(above).alias("tp"), F.sum("_q").over(above).alias("fp"),
        (F.sum("_p").over(whole) - F.sum("_p").over(above)).alias("fn"),
    ).filter(F.col("threshold").isNotNull())
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return summed.select("*", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"))


def threshold_by_precision(curve: DataFrame, target: float = C.TARGET_PRECISION) -> DataFrame:
    """Lowest threshold with the target precision and some recall, else the first of best F1."""
    ok = (F.col("precision") >= target) & (F.col("recall") > 0)
    return curve.agg(
        F.min(F.when(ok, F.col("threshold"))).alias("_ok"),
        F.max_by("threshold", F.struct("f1", (-F.col("grid_no")).alias("first"))).alias("_best"),
    ).select(F.coalesce("_ok", "_best").alias("threshold"), F.col("_ok").isNotNull().alias("reached_target"))


# --- bootstrap --------------------------------------------------------------------------


def hashed_draw(*parts: Column) -> Column:
    """Uniform 32-bit integer from a hash of the parts: the same in any engine and any order."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _numbered_clusters(samples: DataFrame) -> DataFrame:
    """(match_id, cluster_id, _i from 1, _c) of the matches with two clusters at least."""
    clusters = samples.select("match_id", "cluster_id").distinct().withColumn(
        SEG, segments.segment_of(F.col("cluster_id"), 4096))
    return stage(segments.number_rows(clusters, ["match_id"], [SEG], ["cluster_id"], name="_i", total="_c").drop(SEG)).filter(F.col("_c") > 1)


def bootstrap_draws(samples: DataFrame, replicates: int = C.BOOTSTRAP_REPLICATES, seed: int = 0) -> DataFrame:
    """(match_id, replicate, cluster_id, times): clusters drawn with replacement, as many as there are."""
    indexed = _numbered_clusters(samples)
    drawn = indexed.select(
        "match_id", "_i", "_c", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    )
    target = hashed_draw(F.lit(seed), F.col("match_id"), F.col("replicate"), F.col("_i")) % F.col("_c") + 1
    counts = drawn.groupBy("match_id", "replicate", target.alias("_i")).agg(F.count(F.lit(1)).alias("times"))
    return counts.join(indexed, ["match_id", "_i"]).select("match_id", "replicate", "cluster_id", "times")


#: clusters of a block of draws, and the tasks that the replicates are dealt to
DRAW_BLOCK, DRAW_TASKS = 4096, 256


def _draw_blocks(indexed: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(match_id, _blk, replicate, times BINARY): how often a replicate draws each cluster of a block, as :func:`bootstrap_draws`.

    A replicate is drawn in one go, a number a cluster of its match, and leaves its task in blocks of counts.
    """
    kind = dict(indexed.dtypes)["match_id"]

    def draw(batches):
        for rows in batches:
            for match, c, replicate in zip(rows["match_id"], rows["_c"], rows["replicate"], strict=True):
                prefix, times = f"{seed}:{match}:{replicate}:".encode(), np.zeros(c, np.int64)
                for low in range(1, c + 1, 1 << 16):
                    digests = b"".join([hashlib.md5(prefix + b"%d" % i).digest()[:4] for i in range(low, min(low + (1 << 16), c + 1))])
                    times += np.bincount(np.frombuffer(digests, ">u4") % c, minlength=c)
                packed = times.astype(np.uint8 if times.max() < 256 else np.uint32)
                yield pd.DataFrame({"match_id": match, "_blk": range(-(-c // DRAW_BLOCK)), "replicate": replicate,
                                    "times": [packed[b:b + DRAW_BLOCK].tobytes() for b in range(0, c, DRAW_BLOCK)]})

    sizes = indexed.filter(F.col("_c") > 1).groupBy("match_id").agg(F.max("_c").alias("_c"))
    each = sizes.select("match_id", "_c", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    return each.repartition(DRAW_TASKS, "match_id", "replicate").mapInPandas(draw, f"match_id {kind}, _blk long, replicate int, times binary")


def bootstrap_window_counts(samples: DataFrame, threshold: float, replicates: int = C.BOOTSTRAP_REPLICATES, seed: int = 0) -> DataFrame:
    """(match_id, replicate, tp, fp, fn) over the clusters of :func:`bootstrap_draws`.

    Draws and the counts of clusters meet in blocks of clusters, a matrix product each; no draw becomes a row.
    """
    counts = window_counts(samples, threshold, ["match_id", "cluster_id"]).withColumn(SEG, segments.segment_of(F.col("cluster_id"), 4096))
    indexed = stage(segments.number_rows(counts, ["match_id"], [SEG], ["cluster_id"], name="_i", total="_c").select("match_id", "_i", "_c", "tp", "fp", "fn"))
    names = ["tp", "fp", "fn"]

    def add(drawn: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
        if not len(drawn):
            return pd.DataFrame(columns=["match_id", "replicate", *names])
        # sums of a block stay far below 2^53: doubles add them exactly
        of = clusters.sort_values("_i")[names].to_numpy(float)
        sums = []
        for low in range(0, len(drawn), 64):
            sums.append(_matrix(drawn["times"].iloc[low:low + 64], len(of)).astype(float) @ of)
        out = pd.DataFrame(np.concatenate(sums).astype(np.int64), columns=names)
        return out.assign(match_id=drawn["match_id"].to_numpy(), replicate=drawn["replicate"].to_numpy())[["match_id", "replicate", *names]]

    blocks = indexed.withColumn("_blk", _draw_block())
    met = _draw_blocks(indexed, replicates, seed).groupBy("match_id", "_blk").cogroup(blocks.groupBy("match_id", "_blk"))
    sums = met.applyInPandas(add, f"match_id {dict(indexed.dtypes)['match_id']}, replicate int, tp long, fp long, fn long")
    return sums.groupBy("match_id", "replicate").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_scores(samples: DataFrame, indexed: DataFrame, drawn: DataFrame) -> DataFrame:
    """(match_id, replicate, probability, _tp, _n): rows drawn and positives among them per score, from blocks of draws.

    Draws meet the counts of their clusters per score in blocks of clusters and leave them added up; no draw becomes a row.
    """
    counts = samples.groupBy("match_id", "cluster_id", "probability").agg(
        F.count_if(F.col("label") == 1).alias("_tp"), F.count(F.lit(1)).alias("_n")).join(indexed, ["match_id", "cluster_id"])
    blocks = counts.select("match_id", _draw_block().alias("_blk"), "_i", "probability", "_tp", "_n", F.lit(None).cast("int").alias("replicate"), F.lit(None).cast("binary").alias("times"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("_i", "bigint"), ("probability", "double"), ("_tp", "bigint"), ("_n", "bigint"))]
    both = blocks.unionByName(drawn.select("match_id", "_blk", *none, "replicate", "times"))

    def add(batches):
        rows = pd.concat(list(batches))
        of = rows[rows["times"].isna()].sort_values("probability")
        draws = rows[rows["times"].notna()]
        if not len(draws):
            return
        at = (of["_i"].to_numpy(np.int64) - 1) % DRAW_BLOCK
        score, names = of["probability"].to_numpy(float), ["_tp", "_n"]
        values = of[names].to_numpy(np.int64)
        match, replicate = rows["match_id"].iloc[0], draws["replicate"].to_numpy(np.int64)
        for first in range(0, len(draws), 256):
            # (cluster, replicate), so that a row of counts is multiplied in one go
            times = np.ascontiguousarray(_matrix(draws["times"].iloc[first:first + 256], at.max() + 1).T)
            for low in range(0, len(at), 8192):
                part = slice(low, low + 8192)
                starts = np.flatnonzero(np.append(True, np.diff(score[part]) != 0))
                taken = times[at[part]]
                tp, n = (np.add.reduceat(taken * values[part, c:c + 1], starts, axis=0) for c in (0, 1))
                s, r = np.nonzero(n)
                yield pd.DataFrame({"match_id": match, "replicate": replicate[first + r], "probability": score[part][starts[s]], "_tp": tp[s, r], "_n": n[s, r]})

    sums = both.groupBy("match_id", "_blk").applyInPandas(_batchwise(add), f"match_id {dict(samples.dtypes)['match_id']}, replicate int, probability double, _tp long, _n long")
    return sums.groupBy("match_id", "replicate", "probability").agg(F.sum("_tp").alias("_tp"), F.sum("_n").alias("_n"))


def _draw_block() -> Column:
    return F.floor((F.col("_i") - 1) / F.lit(DRAW_BLOCK)).cast("bigint")


def _batchwise(fn: Callable) -> Callable:
    """``fn`` typed as the form of ``applyInPandas`` that yields its results in parts."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fn(batches)

    return each


def _matrix(times: Sequence[bytes], n: int) -> np.ndarray:
    """Packed counts as a matrix, a row of ``n`` each: one byte a count, or four where a count is above 255."""
    return np.stack([np.frombuffer(t, np.uint8 if len(t) == n else np.uint32).astype(np.int64) for t in times])


def episode_clusters(samples: DataFrame, episodes: DataFrame, horizon_s: float = C.HORIZON_S) -> DataFrame:
    """Episode to the cluster of its team's last sample in ``[entry - horizon, entry]``; NULL if none."""
    b = lambda t: F.floor(t / F.lit(horizon_s)).cast("bigint")
    entry = F.col("entry_time_s")
    left = episodes.withColumn("_b", F.explode(F.array(b(entry) - 1, b(entry))))
    right = samples.select("match_id", "team", "time_s", "cluster_id", b(F.col("time_s")).alias("_b"))
    met = left.join(right, ["match_id", "team", "_b"], "left")
    near = (F.col("time_s") <= entry) & (F.col("time_s") >= entry - F.lit(horizon_s))
    return met.groupBy("match_id", "team", "entry_time_s").agg(
        F.max_by("cluster_id", F.when(near, F.col("time_s"))).alias("cluster_id"))


def bootstrap_window_metrics(scores: DataFrame, threshold: float) -> DataFrame:
    """Window metrics per replicate from its counts per score (:func:`bootstrap_scores`)."""
    keys, fires = ["match_id", "replicate"], F.col("probability") >= F.lit(float(threshold))
    total = lambda c, n: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    tp, fired, fn = total(fires, F.col("_tp")), total(fires, F.col("_n")), total(~fires, F.col("_tp"))
    counts = scores.groupBy(*keys).agg(tp.alias("tp"), fired.alias("fired"), fn.alias("fn"))
    return counts.join(_area(scores, keys), keys).select(
        *keys, _ratio(F.col("tp"), F.col("fired")).alias("window_precision"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("window_recall"), F.col("pr_auc").alias("window_pr_auc"),
    )


def bootstrap_episode_metrics(
    samples: DataFrame, episodes: DataFrame, draws: DataFrame, threshold: float,
    horizon_s: float = C.HORIZON_S, bridge_s: float = C.ALARM_BRIDGE_S,
) -> DataFrame:
    """Episode metrics per replicate: firing windows of drawn clusters, episodes once per draw.

    A firing window carries the list of replicates that drew its cluster, so it is shuffled once.
    """
    keys = ["match_id", "replicate"]
    alarms = stage(_drawn_alarms(samples.filter(F.col("probability") >= threshold), draws, bridge_s))
    located = episode_clusters(samples, episodes, horizon_s).filter(F.col("cluster_id").isNotNull())
    spans = draws.select(*keys).distinct().join(match_spans(samples), "match_id")
    return episode_metrics(alarms, _drawn_episodes(located, draws), spans, keys, horizon_s).select(
        *keys, F.col("precision").alias("episode_precision"), F.col("recall").alias("episode_recall"), "false_alarms_per_90")


def _drawn_episodes(located: DataFrame, draws: DataFrame) -> DataFrame:
    copies = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return located.join(draws, ["match_id", "cluster_id"]).select("match_id", "replicate", "team", "entry_time_s", copies.alias("_copy")).drop("_copy")


def _drawn_alarms(firing: DataFrame, draws: DataFrame, bridge_s: float) -> DataFrame:
    drawn_in = draws.groupBy("match_id", "cluster_id").agg(F.collect_list(F.col("replicate").cast("int")).alias("replicates"))
    firing = firing.join(drawn_in, ["match_id", "cluster_id"])

    def fires(rows: pd.DataFrame) -> np.ndarray:
        lists = rows["replicates"].to_numpy()
        numbers = np.concatenate(lists)
        on = np.zeros((len(rows), numbers.max() + 1), bool)
        on[np.repeat(np.arange(len(rows)), [len(x) for x in lists]), numbers] = True
        return on

    return variant_alarms(firing.select("match_id", "row_no", "time_s", "team", "replicates"), fires, "replicate", bridge_s=bridge_s)


def _cluster_draws(wanted: DataFrame, indexed: DataFrame, drawn: DataFrame) -> DataFrame:
    """(match_id, cluster_id, times BINARY): how often each replicate draws a wanted cluster, in order of replicates."""
    blocks = wanted.select("match_id", "cluster_id").distinct().join(indexed, ["match_id", "cluster_id"]).withColumn("_blk", _draw_block())
    sized = blocks.withColumn("_size", F.least(F.lit(DRAW_BLOCK), F.col("_c") - F.col("_blk") * DRAW_BLOCK)).select("match_id", "_blk", "_i", "_size", "cluster_id")

    def turn(draws: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
        if not len(clusters):
            return clusters.assign(times=None)[["match_id", "cluster_id", "times"]]
        times = _matrix(draws.sort_values("replicate")["times"], clusters["_size"].iloc[0]).T
        rows = times[(clusters["_i"].to_numpy() - 1) % DRAW_BLOCK]
        return clusters.assign(times=[r.astype(np.uint8 if r.max() < 256 else np.uint32).tobytes() for r in rows])[["match_id", "cluster_id", "times"]]

    types = dict(indexed.dtypes)
    return drawn.groupBy("match_id", "_blk").cogroup(sized.groupBy("match_id", "_blk")).applyInPandas(
        turn, f"match_id {types['match_id']}, cluster_id {types['cluster_id']}, times binary")


def bootstrap_alarm_counts(
    samples: DataFrame, episodes: DataFrame, indexed: DataFrame, drawn: DataFrame, threshold: float, replicates: int,
    horizon_s: float = C.HORIZON_S, bridge_s: float = C.ALARM_BRIDGE_S, width: float = segments.SEGMENT_S,
) -> DataFrame:
    """(match_id, replicate, alarms, detected, episodes), as :func:`bootstrap_episode_metrics` counts them.

    Where no window fires for longer than an alarm bridges and an episode reaches, no alarm and no match of any replicate
    passes: the stretches between are cut and matched in a time block, all replicates at once, and leave it as counts.
    Stretches longer than ``width`` are not kept in one task: their alarms become rows.
    """
    keys, types = ["match_id", "replicate"], dict(samples.dtypes)
    clustered = indexed.select("match_id", "cluster_id")
    firing = samples.filter(F.col("probability") >= threshold).select("match_id", "row_no", "time_s", "team", "cluster_id").join(clustered, ["match_id", "cluster_id"], "left_semi")
    named = stage(segments.islands(firing, ["match_id"], "time_s", "time_s", max(bridge_s, horizon_s), "_from", tie=["row_no"], width=width))
    ends = named.groupBy("match_id", "_from").agg((F.max("time_s") - F.col("_from") > F.lit(width)).alias("_long"))
    named = stage(named.join(ends, ["match_id", "_from"]))
    located = stage(episode_clusters(samples, episodes, horizon_s).join(clustered, ["match_id", "cluster_id"], "left_semi"))
    of_cluster = stage(_cluster_draws(named.select("match_id", "cluster_id").union(located.select("match_id", "cluster_id")), indexed, drawn))

    block = lambda t: segments.segment_of(t, width)
    entry = F.col("entry_time_s")
    # every block in which a stretch may begin that reaches the episode; counted in one of them
    spread = located.withColumn("_blk", F.explode(F.sequence(block(entry - F.lit(width + horizon_s + 1.0)), block(entry))))
    marks = named.filter(~F.col("_long")).select("match_id", block(F.col("_from")).alias("_blk"), "time_s", "row_no", "team", "cluster_id", F.lit(False).alias("counted")).unionByName(
        spread.select("match_id", "_blk", entry.alias("time_s"), F.lit(None).cast(types["row_no"]).alias("row_no"), "team", "cluster_id", (F.col("_blk") == block(entry)).alias("counted")))
    marks = stage(marks)
    # columns of their own: both sides of the grouping below come from the marks
    asked = marks.select(*[F.col(c).alias(c) for c in ("match_id", "_blk", "cluster_id")]).distinct()
    vectors = asked.join(of_cluster, ["match_id", "cluster_id"])

    def count(rows: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
        clusters = clusters.sort_values("cluster_id")
        place = np.searchsorted(clusters["cluster_id"].to_numpy(), rows["cluster_id"].to_numpy())
        rows = rows.assign(place=place).sort_values(["time_s", "row_no"])
        fires = rows[rows["row_no"].notna()]
        t, team, at = (fires[c].to_numpy() for c in ("time_s", "team", "place"))
        entries = rows[rows["row_no"].isna()]
        out = np.zeros((replicates, 3), np.int64)
        # times[cluster, replicate], some replicates at a time
        every = [np.frombuffer(x, np.uint8 if len(x) == replicates else np.uint32) for x in clusters["times"]]
        for low in range(0, replicates, 64):
            times = np.stack([x[low:low + 64] for x in every]).astype(np.int64)
            variant, a, b = _cut(times[at] > 0, t, team, bridge_s) if len(at) else (np.empty(0, np.int64),) * 3
            part = out[low:low + 64]
            part[:, 0] = np.bincount(variant, minlength=len(part))
            part[:, 2] = times[entries["place"].to_numpy()[entries["counted"].to_numpy(bool)]].sum(axis=0)
            for side, own in entries.groupby("team"):
                mine = team[a] == side
                part[:, 1] += _detected(variant[mine], t[a[mine]], t[b[mine]], own["time_s"].to_numpy(), times[own["place"].to_numpy()], horizon_s)
        return pd.DataFrame(out, columns=["alarms", "detected", "episodes"]).assign(match_id=rows["match_id"].iloc[0], replicate=range(replicates))[[*keys, "alarms", "detected", "episodes"]]

    met = marks.groupBy("match_id", "_blk").cogroup(vectors.groupBy("match_id", "_blk"))
    counts = met.applyInPandas(count, f"match_id {types['match_id']}, replicate int, alarms long, detected long, episodes long")
    long = named.filter("_long")
    if not long.isEmpty():
        def rows_of(batches):
            for rows in batches:
                for match, cluster, x in zip(rows["match_id"], rows["cluster_id"], rows["times"], strict=True):
                    times = np.frombuffer(x, np.uint8 if len(x) == replicates else np.uint32)
                    yield pd.DataFrame({"match_id": match, "replicate": np.flatnonzero(times), "cluster_id": cluster, "times": times[times > 0].astype(np.int64)})

        draws = of_cluster.mapInPandas(rows_of, f"match_id {types['match_id']}, replicate int, cluster_id {types['cluster_id']}, times long")
        alarms = stage(_drawn_alarms(long, draws, bridge_s))
        matched = match_alarms(alarms, _drawn_episodes(located, draws), keys, horizon_s)
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        counts = counts.unionByName(alarms.select(*keys, one.alias("alarms"), none.alias("detected"), none.alias("episodes"))).unionByName(
            matched.select(*keys, none.alias("alarms"), one.alias("detected"), none.alias("episodes")))
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("alarms", "detected", "episodes")])


def _detected(variant: np.ndarray, start: np.ndarray, end: np.ndarray, entry: np.ndarray, copies: np.ndarray, horizon_s: float) -> np.ndarray:
    """Alarms of one team that find an episode per variant: :func:`match_alarms`, the k-th alarm of all variants at once.

    Alarms come by variant and time. The copies drawn of an episode stand side by side in a variant's list, so an alarm meets a range
    of it and takes the first place behind those taken.
    """
    n = copies.shape[1]
    before = np.concatenate([np.zeros((1, n), np.int64), np.cumsum(copies, axis=0)])
    low = before[np.searchsorted(entry, start, "left"), variant]
    high = before[np.searchsorted(entry - horizon_s, end, "right"), variant]
    meets = low < high
    variant, low, high = variant[meets], low[meets], high[meets]
    nth = np.arange(len(variant)) - np.searchsorted(variant, variant, "left")
    found, free = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(nth, kind="stable")
    for these in np.split(order, np.cumsum(np.bincount(nth))[:-1]) if len(order) else ():
        v = variant[these]
        pick = np.maximum(free[v], low[these])
        took = pick < high[these]
        found[v] += took
        free[v] = np.where(took, pick + 1, free[v])
    return found


def percentile_interval(metrics: DataFrame, names: Sequence[str], keys: Sequence[str] = MATCH, level: float = C.CONFIDENCE_LEVEL) -> DataFrame:
    """Long table (keys, metric, low, high) of percentile intervals, NULL values skipped."""
    alpha = (1.0 - level) / 2.0
    long = metrics.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(*keys, "m.*")
    q = long.filter(F.col("value").isNotNull()).groupBy(*keys, "metric").agg(F.percentile("value", [alpha, 1.0 - alpha]).alias("q"))
    return q.select(*keys, "metric", F.round(F.col("q")[0], 5).alias("low"), F.round(F.col("q")[1], 5).alias("high"))


def cluster_bootstrap(
    samples: DataFrame, episodes: DataFrame, threshold: float, replicates: int = C.BOOTSTRAP_REPLICATES, seed: int = 0,
) -> DataFrame:
    """Percentile intervals per match; matches with fewer than two clusters have none."""
    indexed = _numbered_clusters(samples)
    drawn = stage(_draw_blocks(indexed, replicates, seed))
    w = percentile_interval(bootstrap_window_metrics(stage(bootstrap_scores(samples, indexed, drawn)), threshold),
                            ["window_precision", "window_recall", "window_pr_auc"])
    counts = bootstrap_alarm_counts(samples, episodes, indexed, drawn, threshold, replicates)
    # every replicate of a match, those without firing windows and episodes too
    spans = match_spans(samples.join(indexed.select("match_id").distinct(), "match_id", "left_semi")).withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = spans.join(counts, ["match_id", "replicate"], "left").fillna(0, ["alarms", "detected", "episodes"])
    e = percentile_interval(rows.select(
        "match_id", _ratio(F.col("detected"), F.col("alarms")).alias("episode_precision"), _ratio(F.col("detected"), F.col("episodes")).alias("episode_recall"),
        ((F.col("alarms") - F.col("detected")) / F.greatest(F.col("minutes"), F.lit(1e-9)) * C.MATCH_MINUTES).alias("false_alarms_per_90"),
    ), ["episode_precision", "episode_recall", "false_alarms_per_90"])
    return w.unionByName(e)


# --- folds, parity, latency -------------------------------------------------------------


def lomo_folds(samples: DataFrame, held_out: Sequence) -> DataFrame:
    """Training rows of every leave-one-match-out fold, labelled with the match left out."""
    folds = F.filter(F.array(*map(F.lit, held_out)), lambda m: m != F.col("match_id"))
    return samples.withColumn("held_out", F.explode(folds))


def lomo_summary(fold_metrics: DataFrame) -> DataFrame:
    """Per model: folds and means, NULL PR-AUC skipped."""
    ordered = lambda c, d: F.transform(
        F.array_sort(F.collect_list(F.struct("held_out", F.round(c, d).alias("v")))), lambda s: s["v"])
    return fold_metrics.groupBy("model").agg(
        F.array_sort(F.collect_list("held_out")).alias("folds"),
        ordered("pr_auc", 4).alias("window_pr_auc"), F.round(F.avg("pr_auc"), 4).alias("window_pr_auc_mean"),
        ordered("precision", 4).alias("episode_precision"), F.round(F.avg("precision"), 4).alias("episode_precision_mean"),
        ordered("recall", 4).alias("episode_recall"), F.round(F.avg("recall"), 4).alias("episode_recall_mean"),
        ordered("false_alarms_per_90", 2).alias("false_alarms_per_90"),
        ordered("median_warning_s", 2).alias("median_warning_s"),
    )


def ranks(df: DataFrame, keys: Sequence[str], names: dict[str, str], order: Sequence[str]) -> DataFrame:
    """Adds dense ranks per key: for each name that of a value column, ties by ``order``, whose first column is a number."""
    for name, value in names.items():
        cut = sliced(df, keys, value, "_slice", tie=order[0])
        df = segments.number_rows(cut, list(keys), ["_slice", "_slice_tie"], [value, *order], name=name).drop("_slice", "_slice_tie")
    return df


def score_parity(left: DataFrame, right: DataFrame, on: Sequence[str], keys: Sequence[str] = (), tolerance: float = C.PARITY_TOLERANCE) -> DataFrame:
    """Two score sets compared row by row: differences and the largest change of rank."""
    both = left.select(*on, F.col("probability").alias("_a")).join(right.select(*on, F.col("probability").alias("_b")), list(on))
    rest = [c for c in on if c not in keys]
    # many rows of one score are cut by the column that orders them next
    ranked = ranks(stage(both), keys, {"_ra": "_a", "_rb": "_b"}, rest)
    diff = F.abs(F.col("_a") - F.col("_b"))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.max(diff).alias("max_abs_diff"), F.avg(diff).alias("mean_abs_diff"),
        (F.max(diff) <= tolerance).alias("within_tolerance"), F.max(F.abs(F.col("_ra") - F.col("_rb"))).alias("max_rank_change"),
    )


def latency_stats(timings: DataFrame, keys: Sequence[str], value: str, batch_size: int = 1) -> DataFrame:
    """p50, p95, p99, mean and throughput of a latency column in milliseconds."""
    keys = list(keys)
    means = timings.groupBy(*keys).agg(F.count(F.lit(1)).alias("iterations"), F.avg(value).alias("mean_ms"))
    out = means.join(exact_quantiles(timings, keys, value, [0.5, 0.95, 0.99], "_q"), keys)
    return out.select(
        *keys, "iterations", F.col("_q")[0].alias("p50_ms"), F.col("_q")[1].alias("p95_ms"), F.col("_q")[2].alias("p99_ms"),
        "mean_ms", F.when(F.col("mean_ms") > 0, batch_size / (F.col("mean_ms") / 1000.0)).alias("throughput_per_s"))
