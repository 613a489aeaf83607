"""Summarise the physical plan of every registered query.

For each query: the operator tree (node names only, literals dropped),
every scan's ReadSchema and PushedFilters, and counts of the nodes that
matter at scale (exchanges, broadcasts, sorts, Python stages).  Writes
Markdown to stdout.

usage: python scripts/explain_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ragtide.plans.catalog import QUERIES  # noqa: E402
from ragtide.session import local_session  # noqa: E402

WATCH = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
         "Sort", "Window", "WindowGroupLimit", "TakeOrderedAndProject", "HashAggregate",
         "MapInArrow", "ArrowEvalPython", "BatchEvalPython", "Generate", "CartesianProduct",
         "BroadcastNestedLoopJoin"]


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def tree(plan: str) -> list[str]:
    """The operator tree of a formatted plan (the final adaptive plan when
    the query has run), node numbers dropped, stage statistics kept."""
    head = plan.split("\n\n")[0]
    if "== Final Plan ==" in head:
        head = head.split("== Final Plan ==", 1)[1].split("+- == Initial Plan ==", 1)[0]
    lines = []
    for line in head.splitlines():
        if not line.strip() or line.startswith("== Physical Plan"):
            continue
        lines.append(re.sub(r" \(\d+\)", "", line.rstrip()))
    return lines


def node_name(line: str) -> str:
    return re.sub(r"^[ :|+\-]*(\* )?", "", line).split(" ")[0].rstrip(",")


def scans(plan: str) -> list[tuple[str, str, str]]:
    out = []
    for block in plan.split("\n\n"):
        block = block.strip()
        if "Scan parquet" not in block.split("\n")[0]:
            continue
        loc = re.search(r"Location: \S+ \[(.*?)\]", block)
        pf = re.search(r"PushedFilters: (\[.*?\])", block)
        part = re.search(r"PartitionFilters: (\[.*?\])", block)
        rs = re.search(r"ReadSchema: (.*)", block)
        filters = (pf.group(1) if pf else "[]") + (f"; PartitionFilters {part.group(1)}" if part else "")
        out.append((os.path.basename(loc.group(1)) if loc else "?", filters, rs.group(1) if rs else "?"))
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `scripts/explain_plans.py` at `{os.path.basename(sf.rstrip('/'))}` on local[8] "
          "(AQE on). Each query is run first, so the tree is the final adaptive plan: `*` marks "
          "whole-stage-codegen nodes, and query stages carry the row counts and bytes that crossed them. "
          "Per query: node counts, the scans with their pruned `ReadSchema` and pushed filters, and the "
          "tree. An `Exchange` with `REPARTITION_BY_NUM` right above a scan is `spread()`, which only "
          "appears when a test file has fewer splits than the session has cores.\n")
    for name, q in QUERIES.items():
        df = q(spark, sf)
        df.collect()                      # small at this scale; makes the adaptive plan final
        p = formatted(df)
        t = tree(p)
        names = [node_name(x) for x in t]
        counts = {w: sum(1 for n in names if n == w) for w in WATCH}
        counts["codegen nodes"] = sum(1 for x in t if re.match(r"^[ :|+\-]*\* ", x))
        print(f"## {name}\n")
        print(", ".join(f"{k}: {v}" for k, v in counts.items() if v) or "no watched nodes")
        print()
        for loc, filters, rs in scans(p):
            print(f"- scan `{loc}` PushedFilters {filters}; ReadSchema `{rs}`")
        print("\n```")
        print("\n".join(t))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
