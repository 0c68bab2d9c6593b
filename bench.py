"""Headline queries at one scale, warm session, median of repeated runs.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3), BENCH_SHUFFLE_PARTITIONS (default 2 x cpus).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from recall.session import build_session  # noqa: E402

HEADLINE = [
    "schedule_state", "avg_reviews_per_month", "cards_due", "word_lookup_fallback", "new_word_sentences",
    "rich_text_blocks", "schedule_trace", "vocabulary_coverage", "review_queue", "words_from_cards",
    "words_add_new", "reviews_apply", "cards_add",
]


def run(df) -> None:
    # Materialise the whole result without shipping it to the driver.
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, cpus * 2)))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=partitions,
                          extra={"spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": "64m"})
    from recall.plans.registry import all_queries
    qs = all_queries()
    times = {}
    for name in HEADLINE:
        fn = qs[name][0]
        run(fn(spark, sf_dir))  # warm-up
        samples = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(fn(spark, sf_dir))
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    name = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(name)
    except ValueError:
        sf = name
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
