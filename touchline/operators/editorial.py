"""Scores to viewer insights: ordered suppression rules with consecutive, cooldown and repeat state."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import constants as C
from touchline.functions import scoring, text
from touchline.plans import segments
from touchline.plans.anchored import anchored_groups
from touchline.plans.segments import SEG, SEGMENT_ROWS
from touchline.session import stage

KEY = ["match_id"]


def service_reason(scored: DataFrame, models: DataFrame, schema_hash: str) -> DataFrame:
    """Adds ``service_reason``: no model registered, or one trained against another feature schema."""
    m = models.select(F.col("name").alias("model"), F.col("feature_schema_hash").alias("_hash"))
    joined = scored.join(m, "model", "left")
    reason = F.when(F.col("_hash").isNull(), "model_unavailable").when(F.col("_hash") != schema_hash, "schema_mismatch")
    return joined.withColumn("service_reason", reason).drop("_hash")


def first_reason(scored: DataFrame, threshold: float) -> Column:
    """Rules that need no memory, in order; NULL marks a candidate."""
    invalid = ~F.col("window_valid")
    short = F.col("invalid_reason") == "insufficient_frames"
    reason = F.when(invalid & F.coalesce(short, F.lit(False)), "insufficient_frames").when(invalid, "invalid_window")
    if "service_reason" in scored.columns:
        reason = reason.when(F.col("service_reason").isNotNull(), F.col("service_reason"))
    return (
        reason.when(F.col("is_dead_ball") > 0.5, "dead_ball")
        .when(F.col("ball_in_box") > 0.5, "already_in_box")
        .when(F.col("probability") < threshold, "low_confidence")
    )


def _sustained(rows: DataFrame, min_consecutive: int, max_staleness_s: float) -> DataFrame:
    """Adds ``_late`` (reason of rules 5 and 6) for candidates, NULL elsewhere.

    A suppression by rules 1 to 4 resets the counter, so without late reviews the counter is the
    number of candidates since the last such row. A sustained candidate reviewed too late also
    resets it; with a minimum of two, a run of late rows then alternates between counting one and
    resetting, which is the parity of its length.
    """
    candidate = F.col("_first").isNull()
    order = ["row_no"]
    if "now_s" not in rows.columns:
        counted = segments.count_since(rows, KEY, order, ~candidate, "_consecutive", count_reset=False)
        late = F.when(candidate & (F.col("_consecutive") < min_consecutive), "not_yet_sustained")
        return counted.withColumn("_late", late).drop("_consecutive")
    if min_consecutive != 2:
        raise ValueError("late reviews are defined for a minimum of two consecutive windows")
    stale = candidate & (F.col("now_s") - F.col("time_s") > max_staleness_s)
    kind = F.when(~candidate, "reset").when(~stale, "fresh")
    typed = rows.withColumn("_kind", kind)
    based = segments.last_known(typed, KEY, order, {"_base": F.col("_kind")})
    run = segments.count_since(based, KEY, order, F.col("_kind").isNotNull(), "_run", count_reset=False)
    from_zero = F.coalesce(F.col("_base") == "reset", F.lit(True))
    odd = F.col("_run") % 2 == 1
    zero = F.when(F.col("_kind") == "reset", True).when(F.col("_kind") == "fresh", False).otherwise(
        F.when(odd, ~from_zero).otherwise(from_zero))
    seen = segments.previous(run.withColumn("_zero", zero), KEY, order, {"_was_zero": "_zero"})
    first = F.coalesce("_was_zero", F.lit(True))
    late = F.when(candidate & first, "not_yet_sustained").when(stale, "stale_situation")
    return seen.withColumn("_late", late).drop("_kind", "_base", "_run", "_zero", "_was_zero")


def editorial_review(
    scored: DataFrame, threshold: float, cooldown_s: float = C.COOLDOWN_S, duplicate_s: float = C.DUPLICATE_WINDOW_S,
    min_consecutive: int = C.MIN_CONSECUTIVE, max_staleness_s: float = C.MAX_STALENESS_S, width: int = SEGMENT_ROWS,
) -> DataFrame:
    """One outcome per scored row: an insight, or the first rule that withheld it.

    ``scored``: match_id, row_no (review order), time_s, period, team, probability, window_valid,
    invalid_reason, the features the rules and facts read; optionally now_s and service_reason.
    Headlines are one per kind, so the repeat window covers the cooldown: an insight of a kind blocks
    its kind for ``duplicate_s``, named ``cooldown`` in the first part and ``duplicate_recent`` after.
    """
    if cooldown_s > duplicate_s:
        raise ValueError("the repeat window has to cover the cooldown")
    now = F.col("now_s") if "now_s" in scored.columns else F.col("time_s")
    rows = scored.withColumn("_first", first_reason(scored, threshold)).withColumn(
        SEG, segments.segment_of(F.col("row_no"), width))
    kind = scoring.insight_kind(F.col("probability"), F.col("recent_box_entry_count"), F.col("possession_duration_s"), scoring.high_band(threshold))
    judged = _sustained(stage(rows), min_consecutive, max_staleness_s).drop(SEG)
    judged = stage(
        judged.withColumn("kind", F.when(F.col("_first").isNull(), kind))
        .withColumn("reason", F.coalesce("_first", "_late")).withColumn("reviewed_s", now).drop("_first", "_late")
    )
    open_rows = judged.filter(F.col("reason").isNull())
    grouped = anchored_groups(open_rows, [*KEY, "kind"], "reviewed_s", "row_no", duplicate_s)
    elapsed = F.col("reviewed_s") - F.col("anchor_s")
    repeated = F.when(~F.col("opens_group"), F.when(elapsed < cooldown_s, "cooldown").otherwise("duplicate_recent"))
    settled = grouped.withColumn("reason", repeated).drop("anchor_s", "opens_group")
    everything = judged.filter(F.col("reason").isNotNull()).unionByName(settled)
    emitted = F.col("reason").isNull()
    chosen = text.facts()
    return everything.withColumn("facts", F.when(emitted, chosen)).select(
        "match_id", "row_no", "time_s", "period", "team", "kind", "reason", emitted.alias("emitted"),
        F.when(emitted, text.headline(F.col("kind"))).alias("headline"),
        F.when(emitted, text.detail(F.col("facts"))).alias("detail"), "facts", "probability",
        F.when(emitted, F.col("reviewed_s")).alias("emitted_at_s"),
    )


def recent_insights(outcomes: DataFrame, limit: int = 20) -> DataFrame:
    """Latest emitted insights of each match: a bounded top-k per match."""
    keep = F.struct("emitted_at_s", "row_no", "kind", "headline", "detail", "probability")
    per_block = outcomes.filter("emitted").withColumn("_b", segments.segment_of(F.col("row_no"), SEGMENT_ROWS))
    top = lambda d, keys: d.groupBy(*keys).agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("_top")), asc=False), 1, limit).alias("_top"))
    # top-k inside each block first, so a match brings at most k rows per block together
    blocks = per_block.groupBy("match_id", "_b").agg(F.slice(F.sort_array(F.collect_list(keep), asc=False), 1, limit).alias("_top"))
    supers = top(blocks.withColumn("_b", F.floor(F.col("_b") / 512)), ["match_id", "_b"])
    return top(supers, ["match_id"]).select("match_id", F.posexplode("_top").alias("rank", "i")).select(
        "match_id", (F.col("rank") + 1).alias("rank"), "i.*")


def suppression_rollup(frames: DataFrame, every: int = C.ROLLUP_FRAMES) -> DataFrame:
    """Exact counts per ``every`` processed frames, absent reasons omitted.

    ``frames``: match_id, row_no (dense), emitted, reason; frames without an outcome still count.
    """
    group = F.floor((F.col("row_no") - 1) / F.lit(every)).cast("bigint")
    per_reason = frames.groupBy("match_id", group.alias("interval"), "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("emitted", F.lit(False))).alias("e"))
    return per_reason.groupBy("match_id", "interval").agg(
        F.sum("n").alias("frames"), F.sum("e").alias("emitted"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("counts"),
    )


def stage_counters(rows: DataFrame, *labels: str, confidence: str = "probability", latency: str = "latency_s") -> DataFrame:
    """Counters by label and two histograms, of confidence and of latency, from one aggregate.

    ``metric``, labels, ``le``, ``n``, ``total``: of ``outcomes`` the count, ``le`` and ``total`` NULL; of a histogram a row a
    cumulative bucket, the last one infinite, with the sum of what was observed. A missing value is counted, not observed.
    """
    families = (("confidence", confidence, C.CONFIDENCE_BUCKETS), ("latency", latency, C.LATENCY_BUCKETS))
    counts = rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("_all"), *[
        m for name, value, buckets in families for m in (
            *[F.count_if(F.col(value) <= b).alias(f"_{name}{i}") for i, b in enumerate(buckets)],
            F.count(value).alias(f"_{name}"), F.sum(value).alias(f"_{name}_sum"))
    ])
    line = lambda metric, le, n, total: F.struct(
        F.lit(metric).alias("metric"), F.lit(le).cast("double").alias("le"), F.col(n).alias("n"), total.cast("double").alias("total"))
    lines = [line("outcomes", None, "_all", F.lit(None))] + [
        line(name, le, n, F.col(f"_{name}_sum")) for name, _, buckets in families
        for le, n in (*[(float(b), f"_{name}{i}") for i, b in enumerate(buckets)], (float("inf"), f"_{name}"))
    ]
    return counts.select(*labels, F.explode(F.array(*lines)).alias("_l")).select("_l.metric", *labels, "_l.le", "_l.n", "_l.total")


def histogram(rows: DataFrame, value: str, buckets=C.CONFIDENCE_BUCKETS, keys=()) -> DataFrame:
    """Cumulative buckets (le), with count and sum of the observations."""
    counts = rows.groupBy(*keys).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)],
        F.count(value).alias("_all"), F.sum(value).alias("total"))
    lines = F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(buckets)
    ], F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")))
    return counts.select(*keys, "total", F.explode(lines).alias("l")).select(*keys, "l.*", "total")
