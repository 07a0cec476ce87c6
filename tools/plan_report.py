"""Summarise the executed (final adaptive) plan of every registered query.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

Per query: Spark jobs and stages actually run (status tracker), and from the
final plan text: shuffles, broadcasts, single-partition exchanges, windows,
sorts, Python stages, whether whole-stage codegen is used, and the columns
each parquet scan reads. A scalar subquery is printed at every use but
executed once, so plan-text counts can exceed what runs; jobs/stages do not.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablestats.session import build_session  # noqa: E402

PY_NODES = ("ArrowEvalPython", "MapInPandas", "MapInArrow", "PythonMapInArrow", "FlatMapGroupsInPandas", "BatchEvalPython")


def summarise(plan: str) -> dict:
    final = plan.split("== Initial Plan ==")[0]
    lines = final.split("\n")

    def count(pat):
        return sum(1 for ln in lines if re.search(pat, ln))
    scans = sorted(set(re.findall(r"FileScan parquet [^\n]*?ReadSchema: struct<([^>]*)>", final)))
    return {
        "shuffles": count(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin"),
        "single": count(r"Exchange SinglePartition"),
        "broadcast": count(r"BroadcastExchange"),
        "windows": count(r"\bWindow \["),
        "sorts": count(r"\bSort \["),
        "python": sum(final.count(n) for n in PY_NODES),
        "codegen": "*(" in final,
        "scans": [",".join(f.split(":")[0] for f in sc.split(",")) for sc in scans],
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from tablestats.plans import QUERIES
    spark = build_session("local[8]", 8)
    print("# Executed plans of the registered queries\n")
    print(f"Final adaptive plans at `{sf_dir}` (`tools/plan_report.py`). `single` counts exchanges into one "
          "partition (final step of a global aggregate or sort over one-row-per-task / per-partition tables); "
          "`python` counts Arrow Python stages.\n")
    print("| query | jobs | stages | shuffles | single | broadcast | windows | sorts | python | codegen | columns read |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    sc = spark.sparkContext
    tracker = sc.statusTracker()
    for name, fn in sorted(QUERIES.items()):
        group = f"plan-{name}"
        sc.setJobGroup(group, name)
        df = fn(spark, sf_dir)
        df.collect()  # executes this DataFrame's own plan, so its final adaptive plan is available
        jobs = tracker.getJobIdsForGroup(group)
        stages = sum(len(tracker.getJobInfo(j).stageIds) for j in jobs)
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        cols = "; ".join(s["scans"]) if s["scans"] else "-"
        print(f"| {name} | {len(jobs)} | {stages} | {s['shuffles']} | {s['single']} | {s['broadcast']} | "
              f"{s['windows']} | {s['sorts']} | {s['python']} | {'yes' if s['codegen'] else 'no'} | {cols} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
