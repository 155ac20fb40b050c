"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kurzwerk.checks import queries as Q  # noqa: E402
from kurzwerk.session import local_session  # noqa: E402

HEADLINE = [
    "clean_text",
    "sentences",
    "chunk_text",
    "chunk_text_default",
    "bpe_chunks",
    "classify_upload",
    "assemble_pages",
    "summarize_chunks",
    "merge_summaries",
    "document_report",
    "document_report_small_window",
    "map_summarizer",
    "coverage",
    "rouge1",
    "rouge_l",
    "rouge_stemmed",
    "eval_detail",
    "eval_report",
    "incremental_intake",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "kurzwerk-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("kurzwerk.read.tasks", str(cpus))
    known = Q.registered()
    # Start the JVM paths and the Python workers before anything is timed.
    known["chunk_text"](spark, folder).limit(1).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    n_docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    total = round(sum(seconds.values()), 3)
    line = {
        "metric": "total seconds of the headline queries",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if "document_report" in seconds:
        line["documents_per_second"] = round(n_docs / seconds["document_report"], 1)
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
