"""Benchmark the headline queries.

Runs each query of HEADLINE on the driver tables in $BENCH_SF_DIR (default
/root/testdata/sf0.1) with local[$BENCH_CPUS] and prints one JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is executed to completion with the no-op sink (nothing is
collected to the driver); the reported time is the median of $BENCH_REPEAT runs
after one untimed warm-up pass over the sf0.01 tables.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textlytics.plans.catalog import QUERIES  # noqa: E402
from textlytics.session import build_session  # noqa: E402

HEADLINE = [
    "index_documents",      # S3: postings of every field
    "terms_by_doc_freq",    # A4: df ranking of the whole vocabulary
    "top_terms",            # A6: flagship
    "term_distribution",    # R1: coverage with running share
    "batch_search",         # Q6: ranked search for a keyword table
    "keyword_detail_report",  # R4: keyword × title substring matches
    "pairwise_cosine",      # M4: classes of equal documents, and all their pairs that share a term
    "term_cooccurrence_all",  # M2: pairs of the whole vocabulary that a hundredth of the documents have
    "nb_classify",          # C2: Naive Bayes labelling of every document
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus) * 2, app_name="textlytics-bench")
    # warm-up, not timed: every measured query once on the sf0.01 tables
    # (JIT, code generation, Python workers), so the medians are steady state
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    for name in only:
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
