"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores. Each query is run to the end
(every row is produced, nothing is collected) after a warm-up on the smallest tables.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "m2_term_gap", "a6_mean_top_score", "m1_tfidf", "a2_document_frequency", "m4_entities", "m5_sentiment",
    "m3_cluster_fit", "c10_main_text", "c8_fetch_outcome", "c5_organic_results", "k4_hits_and_misses", "w3_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("termgap-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from termgap.queries import QUERIES

    def run(name: str, where: str = sf_dir) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    small = re.sub(r"sf[\d.]+", "sf0.001", sf_dir)
    run("m2_term_gap", small if os.path.isdir(small) else sf_dir)
    times = {name: run(name) for name in HEADLINE}
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
