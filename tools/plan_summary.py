"""Summarise the physical plan of each headline analysis (final AQE plan).

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
Counts operators in the plan printed by ``explain`` after one execution.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "hash exchanges": r"Exchange hashpartitioning",
    "range exchanges": r"Exchange rangepartitioning",
    "broadcasts": r"BroadcastExchange",
    "reused": r"ReusedExchange",
    "broadcast joins": r"BroadcastHashJoin",
    "sort-merge joins": r"SortMergeJoin",
    "partial window limits": r"WindowGroupLimit .*Partial",
    "Expand": r"\bExpand\b",
    "Generate": r"\bGenerate\b",
    "object/sort aggs": r"ObjectHashAggregate|SortAggregate",
}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="extended")
    return buf.getvalue()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from ledgerline.plans.catalog import HEADLINE, registry
    from ledgerline.session import local_session

    spark = local_session(8)
    reg = registry()
    print(f"# Physical plans of the headline analyses ({os.path.basename(sf_dir)}, final AQE plans)\n")
    print("Generated by `tools/plan_summary.py`. Counts are operator occurrences in the executed plan.\n")
    print("| query | " + " | ".join(PATTERNS) + " |")
    print("| --- |" + " --- |" * len(PATTERNS))
    for name in HEADLINE:
        df = reg[name].build(spark, sf_dir)
        df.collect()
        text = plan_text(df)
        final = text.split("== Physical Plan ==")[-1].split("+- == Initial Plan ==")[0]
        counts = [str(len(re.findall(p, final))) for p in PATTERNS.values()]
        print(f"| {name} | " + " | ".join(counts) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
