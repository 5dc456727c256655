"""Summarise the physical plan of every registered query into PLANS.md.

usage: python scripts/plan_summary.py [sf_dir]

Counts per query: shuffle exchanges, broadcast exchanges, broadcast-hash and
sort-merge joins, window operators, hash / sort aggregates, Parquet scans
with pushed filters.  Each DataFrame's own plan is executed and read
afterwards (AQE final plan, without reused exchanges); jobs that a query
runs while it is built (fits, written tables) are not part of it.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from telemetrix.plans import all_queries  # noqa: E402
from telemetrix.session import executed_plan, get_spark  # noqa: E402

PATTERNS = {
    "shuffles": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "bhj": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "windows": r"\bWindow \[",
    "hash_agg": r"HashAggregate\(",
    "sort_agg": r"SortAggregate\(",
    "scans": r"FileScan parquet",
    "pushed": r"PushedFilters: \[[^\]]+\]",
}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(shuffle_partitions=8)
    rows = []
    for name, fn in all_queries().items():
        plan = "\n".join(line for line in executed_plan(fn(spark, sf)).splitlines() if "ReusedExchange" not in line)
        counts = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        rows.append((name, counts))
    out = ["# Physical plans of the registered queries", "",
           f"Plans that ran (AQE final plans) at `{sf}`, from `scripts/plan_summary.py`. Columns count operators in the plan text,",
           "reused exchanges and jobs run while a query is built (fits, written tables) not included:",
           "shuffle exchanges, broadcast exchanges, broadcast-hash joins, sort-merge joins, window operators,",
           "hash / sort aggregates, Parquet scans and scans with pushed filters (tables written with",
           "`session.materialize` count as scans).", "",
           "| query | " + " | ".join(PATTERNS) + " |", "|---|" + "---|" * len(PATTERNS)]
    for name, c in rows:
        out.append(f"| {name} | " + " | ".join(str(c[k]) for k in PATTERNS) + " |")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out) + "\n")
    print(f"wrote {path} ({len(rows)} queries)")


if __name__ == "__main__":
    main()
