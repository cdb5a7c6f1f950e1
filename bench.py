"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and run in full (no-op sink). All queries run once as warm-up, then three times; the
figure is the median of the three, plan building included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitescan import build_session  # noqa: E402
from sitescan.session import scratch  # noqa: E402
from sitescan_queries.registry import QUERIES  # noqa: E402

HEADLINE = [
    "p1_generate_peaks", "p1_generate_sites", "p1_generate_genes", "p2_fasta_export", "p3_cooccupancy_sites",
    "p3_cooccupancy_hits", "j1_nearby_genes", "j3_translated_expression", "j4_genes_around",
    "a1_peak_gene_stats", "a3_distinct_genes", "a5_first_fold_change", "a6_expression_conflicts",
    "a7_gene_string", "w1_row_ordinal", "w2_kmer_windows", "x1_extract_sequences", "x5_word_scan",
    "x6_motif_scan", "s5_fasta_chunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),  # one machine: local is shared
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, list[float]] = {name: [] for name in names}
    for _ in range(runs + 1):
        for name in names:
            start = time.perf_counter()
            with scratch(spark):
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - start)
    seconds = {name: round(statistics.median(t[1:]), 3) for name, t in times.items()}
    print(json.dumps({
        "metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
