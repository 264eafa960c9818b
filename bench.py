"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR: median of three after a warm-up, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import catalog  # noqa: E402
from tessera.session import session  # noqa: E402

HEADLINE = ("stats_by_split", "bounded_prefix", "regex_chunks", "byte_pair_counts", "bpe_encode", "bestfit_rows", "masked_bpb", "step_alignment", "latency_summary", "log_dedup", "same_step_merge", "grouped_accuracy", "chat_render_counts", "document_spans", "running_min", "few_shot_prompt")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            catalog.REGISTRY.queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
