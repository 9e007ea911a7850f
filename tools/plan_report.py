"""Audit the executed physical plan of every catalogue query.

usage: python tools/plan_report.py [--sf DIR] [--out PLANS.md] [name ...]

Runs each query and reads its final adaptive plan:
shuffles, broadcasts, reused exchanges, single-partition exchanges, cross-join
operators, Python UDF operators, and the scans' pruned schema / pushed filters.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MODEL = {"cv_leaderboard", "oof_status_matrix", "oof_rows", "wait_time_cv", "wait_holdout", "score_requests",
         "status_cv_metrics", "value_holdout_ols", "tree_models_exact_label"}


def audit(plan: str) -> dict:
    """Counts over the numbered operator list of the formatted plan (each node,
    including each subquery's, appears once)."""
    nodes = re.findall(r"^\((\d+)\) (\w+)(.*)$", plan, flags=re.M)
    seen = {}
    for num, op, rest in nodes:
        seen.setdefault((num, op), rest)
    ops = [op for (_, op) in seen]
    args = "\n".join(re.findall(r"^Arguments: (.*)$", plan, flags=re.M))
    return {
        "shuffles": ops.count("Exchange"),
        "single_partition": len(re.findall(r"SinglePartition", args)),
        "broadcasts": ops.count("BroadcastExchange"),
        "reused": ops.count("ReusedExchange") + ops.count("ReusedSubquery"),
        "cross_join": ops.count("CartesianProduct") + ops.count("BroadcastNestedLoopJoin"),
        "python": sum(ops.count(o) for o in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                                              "MapInPandas")),
        "smj": ops.count("SortMergeJoin"),
        "bhj": ops.count("BroadcastHashJoin"),
        "pushed": sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)) - {""}),
        "schemas": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))),
    }


def final_only(text: str) -> str:
    """The details of the operators in the final plan's tree (the initial plan's are listed, too)."""
    tree, _, rest = text.partition("== Initial Plan ==")
    if not rest:
        return text
    used = set(re.findall(r"\((\d+)\)\s*$", tree, flags=re.M))
    details = re.split(r"\n(?=\(\d+\) \w)", rest)
    return "\n".join(d for d in details if (m := re.match(r"\((\d+)\)", d)) and m[1] in used)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=None)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from ridelens.plans import catalog
    from ridelens.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8)
    qs = catalog.queries()
    names = a.names or [n for n in qs if n not in MODEL]
    lines = ["| query | shuffles | single-partition | broadcasts | reused | BHJ | SMJ | cross joins | Python ops |",
             "| --- | --- | --- | --- | --- | --- | --- | --- | --- |"]
    details = []
    for n in names:
        df = qs[n](spark, a.sf)
        df.collect()  # results are reports; only after a run is the adaptive plan final
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = final_only(df._jdf.queryExecution().explainString(mode))
        r = audit(plan)
        lines.append(f"| {n} | {r['shuffles']} | {r['single_partition']} | {r['broadcasts']} | {r['reused']} | "
                     f"{r['bhj']} | {r['smj']} | {r['cross_join']} | {r['python']} |")
        details.append(f"* **{n}** – scans: " + "; ".join(r["schemas"]) +
                       (" – pushed: " + "; ".join(r["pushed"]) if r["pushed"] else ""))
    text = "\n".join(lines + [""] + details) + "\n"
    if a.out:
        with open(a.out, "w") as f:
            f.write(text)
    print(text)


if __name__ == "__main__":
    main()
