"""Headline queries timed on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "chunk_text", "detect_language", "detect_pii", "detect_contact", "html_blocks", "flatten_json", "column_quality",
    "infer_types", "find_joins", "schema_groups", "dedup_corpus_entities", "upsert_relations", "mentions",
    "dominant_person", "vector_search_many", "retrieve", "corpus_overview", "file_breakdown", "rank_files",
    "batch_summary", "progress", "agent_summary",
)


def main() -> None:
    from sheafwork.plans import QUERIES
    from sheafwork.plans.registry import Tables
    from sheafwork.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="20g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    tables.lineitem.count()  # start the engine before the clock
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name].run(tables).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
