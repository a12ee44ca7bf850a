"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The corpus is built once and timed as ``load``; each query runs once to warm up,
and its second run counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "single_term", "or_terms", "regex_terms", "phrase_ordered", "proxy_unordered", "sentence_ordered", "three_group_proxy", "top_n_hits", "meta_equals", "facet_frequency", "aggregation_breakdown", "time_series", "collocates", "collocates_by_field",
    "comparative_collocations", "similar_distributions", "outlier_groups", "collocation_periods", "kwic_right_sort", "concordance_context", "word_frequencies", "tag_census",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", shared).config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from corpuslens.catalog import QUERIES
    from corpuslens.store import corpus

    def once(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    began = time.perf_counter()
    corpus(spark, sf_dir)
    times = {"load": round(time.perf_counter() - began, 3)}
    for name in HEADLINE:
        once(name)
        times[name] = round(once(name), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
