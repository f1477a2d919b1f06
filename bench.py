"""Headline queries, timed once each after a warm-up; prints one JSON line.

Each query's time is told on the error stream as it ends; a run that is asked to stop prints the
line for the queries so far.
"""
from __future__ import annotations

import json
import os
import signal
import sys
import time

from notecoder import catalog
from notecoder.session import local_session

HEADLINE = [
    "remove_noise", "normalize_whitespace", "expand_abbreviations", "segment_sentences",
    "header_candidates", "mentions_numbered", "mention_filter", "section_context",
    "meat_gate", "meat_summary", "rule_specificity", "rule_dx_over_symptoms", "output_filter",
    "dedup_by_code", "document_summary", "validate_code", "eval_detection", "coded_summary", "coded_results",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    queries = catalog.load().QUERIES
    queries["document_summary"](spark, sf_dir).limit(1).collect()
    times: dict[str, float] = {}

    def tell() -> None:
        print(json.dumps({
            "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
            "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        }), flush=True)

    def stopped(*_) -> None:
        tell()
        os._exit(124)

    signal.signal(signal.SIGTERM, stopped)
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    tell()


if __name__ == "__main__":
    main()
