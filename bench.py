"""Seconds of the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR, as one line of JSON."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = "latest_per_key duplicate_decisions leak_packets tier_cascade hard_gates as_of_baseline balanced_aggregates multi_grain entry_exit transition_matrix quote_resolution segment_passages exact_duplicates precision_recall near_duplicates predecessor_topk candidate_scores universe_tiers".split()


def main() -> None:
    from pyspark.sql import SparkSession

    from attestor.plans import evaluation, measures, universe_queries  # noqa: F401  (add their queries)
    from attestor.plans.catalogue import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["cohort_split"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session's readers and writers
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
