"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query first runs on the smallest tables
beside them, to warm up, then ``BENCH_RUNS`` times; the best run counts. Results go to the no-op sink, so
all rows and columns are made.
"""

from __future__ import annotations

import json
import os
import time

from nomenroll.catalog.queries import QUERIES
from nomenroll.session import local_session

HEADLINE = (
    "normalize_ws",
    "strip_html_pages",
    "normalize_fa_default",
    "mentions_pattern",
    "mentions_model",
    "mentions_gazetteer",
    "mentions_quality",
    "qc_rules",
    "qc_split_totals",
    "qc_rule_counts",
    "qc_examples",
    "qc_top_entities",
    "table_verify",
    "table_verify_repeated_keys",
    "table_verify_hot_keys",
)


def seconds(spark, sf_dir: str, name: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    smallest = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = smallest if os.path.isdir(smallest) else sf_dir
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in HEADLINE:
        seconds(spark, warm_dir, name)
        times[name] = round(min(seconds(spark, sf_dir, name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, best run each",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
