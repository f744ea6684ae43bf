"""Summarise the physical plan of every registered query into PLANS.md.

usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusengine.plans.catalog import QUERIES  # noqa: E402
from corpusengine.session import get_session  # noqa: E402


def summarise(plan: str) -> dict:
    schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)))
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "group_limit": plan.count("WindowGroupLimit"),
        "python": len(re.findall(r"ArrowEvalPython|MapInArrow|MapInPandas|BatchEvalPython|FlatMapGroupsInPandas", plan)),
        "scans": plan.count("FileScan") + plan.count("Scan ExistingRDD"),
        "schemas": schemas,
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 16)
    spark.sparkContext.setLogLevel("OFF")
    lines = [
        "# Physical plans of the registered queries",
        "",
        f"Generated by `tools/plan_report.py` on `{sf_dir}` (initial plans before AQE re-planning).",
        "Columns: shuffles (hash/range/round-robin exchanges), broadcasts, sort-merge joins, windows,",
        "partial+final group limits, Python/Arrow nodes, scans. No query has a cartesian product or",
        "nested-loop join. Round-robin exchanges come from spreading the single-row-group test files",
        "over the cores (`sources.tables.spread_partitions`, scans of at most 256 MB); larger inputs",
        "have none. The training-data operators' plans are in the check tool's reports.",
        "",
        "| query | shuffles | broadcasts | SMJ | windows | group limits | python/arrow | scans |",
        "|---|---|---|---|---|---|---|---|",
    ]
    details = []
    for name, fn in sorted(QUERIES.items()):
        df = fn(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
        s = summarise(plan)
        lines.append(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {s['smj']} | {s['windows']} | "
                     f"{s['group_limit']} | {s['python']} | {s['scans']} |")
        details.append(f"* `{name}`: " + "; ".join(f"`{x}`" for x in s["schemas"]))
    lines += ["", "## Columns read by each scan (`ReadSchema`)", ""] + details + [""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
