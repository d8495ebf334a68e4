"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and then three times (once if the warm-up took over
20 seconds), its whole result written to Spark's no-op sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

import pyspark

from platen.plans import registry
from platen.session import local_session

HEADLINE = (
    "page_summary", "p1_text_elements", "a5_a6_paragraphs", "f9_f11_headers", "a13_backgrounds", "a2_j11_appearances", "j9_j10_i5_page_images", "w7_f15_paint_operations", "m5_m8_text_boxes", "j12_element_paragraphs", "e1_e4_property_edits",
    "w3_runs", "t10_j8_translate", "m11_cmyk",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "bench", max(8, 2 * int(cpus) if cpus.isdigit() else 8))
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        times = []
        for k in range(runs + 1):
            if k > 1 and times[0] > 20:
                break
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("/")[2], "cpus": cpus, "spark": pyspark.__version__}))
    spark.stop()


if __name__ == "__main__":
    main()
