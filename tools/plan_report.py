"""Summarise the physical plan of every registered study query (PLANS.md).

For each query: shuffles by kind, broadcasts, join strategies, windows,
scans with their pushed filters, and any Python evaluation. Reads the
plan Spark would run (``explain``); nothing is executed.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def summarise(plan: str) -> dict:
    c = Counter()
    for kind in ("hashpartitioning", "rangepartitioning", "SinglePartition", "RoundRobinPartitioning"):
        c[kind] = len(re.findall(rf"Exchange {kind}", plan))
    c["broadcast"] = plan.count("BroadcastExchange")
    joins = Counter(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)"
                               r"[^\n]*?(Inner|LeftOuter|RightOuter|FullOuter|LeftSemi|LeftAnti|Cross)", plan))
    c["window"] = len(re.findall(r"\bWindow \[", plan))
    c["python"] = len(re.findall(r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas)", plan))
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
    return {"counts": c, "joins": joins, "pushed": pushed}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from cohortspark.session import local_session

    spark = local_session()
    from cohortspark.plans.registry import QUERIES

    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` on `{sf_dir}` (local session, AQE initial plans; "
          "multi-pass operators show the plan after their one-off materialisation).\n")
    print("| query | hash shuffles | range shuffles | single-partition | broadcasts | joins | windows | python |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    notes = []
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        c = s["counts"]
        joins = ", ".join(f"{k[0]} {k[1]}" + (f" x{v}" if v > 1 else "") for k, v in sorted(s["joins"].items())) or "-"
        print(f"| {name} | {c['hashpartitioning']} | {c['rangepartitioning']} | {c['SinglePartition']} | "
              f"{c['broadcast']} | {joins} | {c['window']} | {c['python']} |")
        notes.append((name, s["pushed"]))
    print("\n## Filters pushed into parquet scans\n")
    for name, pushed in notes:
        if pushed:
            print(f"- `{name}`: " + "; ".join(f"`[{p}]`" for p in pushed))
    spark.stop()


if __name__ == "__main__":
    main()
