"""Wall time of the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads."""

from __future__ import annotations

import json
import os
import time

from tracksift.plans import queries as engine
from tracksift.session import build

HEADLINE = [
    "rating_stats", "rating_distribution", "dedup_songs", "line_signals", "song_metrics", "doc_validity", "candidate_topk", "weighted_score", "best_candidate", "playlist_counters",
    "section_lines", "document_patterns", "dedup_documents", "comment_groups", "audio_merge", "best_song_run", "session_activity", "rate_per_minute",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")
    spark = build(f"local[{cpus}]", "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    engine.rating_stats(spark, sf).write.format("noop").mode("overwrite").save()  # the session starts
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        engine.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
