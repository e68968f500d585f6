"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wayline.plans.catalog import QUERIES  # noqa: E402
from wayline.session import build_session  # noqa: E402

HEADLINE = [
    "generate_instructions", "frame_order", "smooth_actions", "action_runs", "key_frames", "dead_reckoning", "enter_leave",
    "diversify_action", "frame_description", "assemble", "top_objects", "top_classes", "tile_plan", "sample_frames_middle",
    "mean_length", "mattr", "hdd", "ngram_diversity", "self_repetition_token", "self_repetition", "self_bleu",
    "homogenization_bleu", "retrieval_metrics", "full_metrics", "extract_score", "consistency_scores", "vote_tally", "survey_order",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in only:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
