"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the folder of given tables, ``BENCH_CPUS`` the local
threads, ``BENCH_QUERIES`` an optional comma list. Each query runs to the end
into Spark's no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "eligible_outings", "weather_span", "presence_absence", "species_floor", "user_summary",
    "idempotent_append", "natural_key_merge", "flatten_observations", "coef_long", "score_grid",
    "best_hotspots", "species_shortlist", "eval_metrics", "leaderboard", "nearby_ranked",
    "photo_top", "fit_ridge", "hour_coding", "stream_ingest", "evaluate_models",
    "calibrate_models", "forecast_request",
]


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    from fieldcast.plans.catalog import registered
    from fieldcast.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", cpus,
                          spark__driver__memory=os.environ.get("BENCH_MEMORY", "6g"),
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    # start-up and first reads are not part of any query
    for t in ("orders", "lineitem", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
