"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

HEADLINE = (
    "top_movers", "f1_filter_detections", "a1_track_summary", "w1_velocities", "w5_fill_gaps", "j1_overlap_pairs", "j2_suppress_dominance", "j12_link_detections",
    "w11_score_candidates", "a8_dominant_angle", "w8_cumulative_transform", "j7_stabilize", "a12_fit_los_minimal_movement", "a14_classify_skill", "k1_limit_skill",
    "x4_resample", "x6_gaussian_smooth", "x14_heatmap", "g15_stratified_holdout", "g16_random_split", "a20_classification_report", "a22_route_distribution",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from trackframe.plans.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", f"file://{scratch}/checkpoints").config("spark.sql.warehouse.dir", f"{scratch}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles the plan's code
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, best of two runs, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"))}))


if __name__ == "__main__":
    main()
