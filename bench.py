"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from creditloom.plans.registry import QUERIES  # noqa: E402
from creditloom.session import local_session  # noqa: E402

HEADLINES = [
    "cross_verify", "itc_reconcile", "gst_describe", "blacklist_matches", "borrower_history", "kv_extract", "column_extract",
    "regex_facts", "bureau_flags", "document_text", "classify_doc", "detect_doc_type", "research_context", "flatten_research",
    "merge_facts", "decide", "explain", "memo_sections", "stratified_split", "top_factors", "score_loans", "attributions",
    "assess_borrowers",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(key: str) -> float:
        start = time.perf_counter()
        QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("gst_revenue")  # starts the engine
    training = time.perf_counter()
    if {"score_loans", "attributions"} & set(only):
        run("score_loans")  # trains and stores the model
    training = round(time.perf_counter() - training, 3)
    times = {}
    for key in only:
        times[key] = run(key)
        print(key, times[key], file=sys.stderr, flush=True)
    companies = spark.read.parquet(f"{sf}/customer.parquet").count()
    out = {
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")),
        "training_seconds": training, "cpus": cpus, "spark": spark.version,
    }
    if "assess_borrowers" in times:
        out["borrowers_per_second"] = round(companies / times["assess_borrowers"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
