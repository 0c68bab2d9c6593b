"""Summarise the executed physical plan of the headline queries (markdown).

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
For each query: shuffle exchanges, reused exchanges, broadcasts, join kinds,
Python stages, and what reached the Parquet scans.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from recall.plans.registry import all_queries  # noqa: E402
from recall.session import build_session  # noqa: E402


def _table(location: str) -> str:
    m = re.search(r"/(\w+)\.parquet", location)
    return m.group(1) if m else "work table"


def summary(plan: str) -> dict:
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\].*?Location: \w+\(\d+ paths\)\[([^\]]*)\].*?"
                       r"PushedFilters: \[([^\]]*)\]", plan)
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
                                   plan)),
        "reused": plan.count("ReusedExchange"),
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": ", ".join(f"{k}×{plan.count(k)}" for k in ["BroadcastHashJoin", "SortMergeJoin",
                                                             "ShuffledHashJoin"] if plan.count(k)) or "-",
        "python": plan.count("MapInPandas") + plan.count("FlatMapGroupsInPandas"),
        "scans": "; ".join(sorted({f"{_table(loc)}: {cols.count(',') + 1} cols" + (f", pushed {f}" if f else "")
                                   for cols, loc, f in scans})) or "checkpoint only",
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 16)
    qs = all_queries()
    print(f"# Executed plans of the headline queries\n\nInput `{sf}`, `local[8]`, 16 shuffle partitions, "
          "AQE on. Generated by `scripts/plan_report.py` from the final adaptive plans.\n")
    print("| query | shuffles | reused | broadcasts | joins | python stages | scans |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name in HEADLINE:
        df = qs[name][0](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        s = summary(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{name}` | {s['shuffles']} | {s['reused']} | {s['broadcasts']} | {s['joins']} | {s['python']} "
              f"| {s['scans']} |")
    spark.stop()


if __name__ == "__main__":
    main()
