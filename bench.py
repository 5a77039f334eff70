"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import time

from touchline.catalog import analysis, composite, core, live  # noqa: F401
from touchline.catalog.registry import QUERIES
from touchline.session import local_session

HEADLINES = (
    "entries_by_team", "join_asof_possession", "possession_context", "win_entry_history", "match_features", "win_merge_episodes",
    "build_labels", "score_heuristic", "agg_average_precision", "win_group_alarms", "agg_episode_metrics",
    "editorial_review", "agg_psi", "degrade_stream", "st_context",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "touchline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
