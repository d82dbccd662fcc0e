"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "upsert_latest", "feed_apply", "interval_union", "interval_attribution", "cosine_rank",
    "ndcg_at_k", "exact_percentiles", "norm_text", "classify_chain", "class_scores",
    "signal_record", "rank_matches",
]


def main() -> None:
    from matchloom.plans import all_queries
    from matchloom.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        # Small files: let every core read and compute.
        "spark.sql.files.maxPartitionBytes": "2m", "spark.sql.files.openCostInBytes": "262144"})
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries().QUERIES
    spark.range(1000).count()
    times = {}
    for name in HEADLINES:
        # Each query starts from its tables: no stage is left over from another one.
        all_queries().forget()
        start = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
