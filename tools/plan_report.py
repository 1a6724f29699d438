"""Summarise the physical plan of every registered query into PLANS.md.

    python tools/plan_report.py [--sf-dir DIR] [--out PLANS.md]

Per query: shuffles (Exchange), broadcasts, scans with their read schema,
scalar subqueries and Python stages of the final (lazy) plan.  Eager
stages a query runs while being built (written sorted tables, summaries) are
listed from the scratch tables they create, and their shuffles from the plans
that Spark's event log has of them.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def _formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _eager_plans(log_dir: str) -> dict[str, list[str]]:
    """Physical plans of the executions that ran while a query was built (the
    job description holds its name)."""
    plans: dict[str, list[str]] = {}
    for folder, _, names in os.walk(log_dir):
        for name in names:
            with open(os.path.join(folder, name), errors="replace") as fh:
                for line in fh:
                    if "SparkListenerSQLExecutionStart" in line:
                        e = json.loads(line)
                        plans.setdefault(e.get("description", ""), []).append(
                            e.get("physicalPlanDescription", ""))
    return plans


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=os.path.join(ROOT, "PLANS.md"))
    args = ap.parse_args()

    from wavelake.session import build_session, ensure_checkpoint_dir
    from wavelake.plans import catalog

    log_dir = tempfile.mkdtemp(prefix="wavelake-plans-")
    spark = build_session("local[8]", shuffle_partitions=8,
                          conf={"spark.ui.enabled": "false",
                                "spark.eventLog.enabled": "true",
                                "spark.eventLog.dir": f"file://{log_dir}",
                                "spark.eventLog.compress": "false",
                                "spark.eventLog.rolling.enabled": "false",
                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    tables_root = os.path.join(ensure_checkpoint_dir(spark), "tables").replace("file:", "")

    rows = []
    for name, fn in catalog.queries().items():
        before = set(os.listdir(tables_root)) if os.path.isdir(tables_root) else set()
        spark.sparkContext.setJobDescription(name)
        df = fn(spark, args.sf_dir)
        after = set(os.listdir(tables_root)) if os.path.isdir(tables_root) else set()
        eager = sorted({re.sub(r"(_[0-9a-f]{12})?-[0-9a-f]{32}$", "", t)
                        for t in after - before})
        plan = _formatted(df)
        tree = plan.split("\n\n")[0]
        shuffles = re.findall(r"Arguments: (hashpartitioning|rangepartitioning|SinglePartition|"
                              r"RoundRobinPartitioning)[^\n]*", plan)
        exch = len(re.findall(r"^\(\d+\) Exchange", plan, re.M))
        bcast = len(re.findall(r"^\(\d+\) BroadcastExchange", plan, re.M))
        scans = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)
        py = sorted(set(re.findall(r"(ArrowEvalPython|MapInPandas|\w*MapInArrow|PythonDataSource\w*|"
                                   r"BatchEvalPython|FlatMapGroupsInPandas)", plan)))
        subq = len(re.findall(r"^Subquery:\d+", plan, re.M))
        rows.append((name, exch, ", ".join(sorted(set(s for s in shuffles))) or "-", bcast,
                     subq, len(scans), ", ".join(py) or "-",
                     ", ".join(eager) or "-", tree))
    spark.stop()
    built = _eager_plans(log_dir)

    def eager_shuffles(name: str) -> str:
        found = [kind for plan in built.get(name, [])
                 for kind in re.findall(r"Arguments: (hashpartitioning|rangepartitioning|"
                                        r"SinglePartition|RoundRobinPartitioning)",
                                        plan.split("== Initial Plan ==")[0])]
        return ", ".join(f"{found.count(k)} {k}" for k in dict.fromkeys(found)) or "-"

    rows = [(*r[:7], eager_shuffles(r[0]), *r[7:]) for r in rows]

    with open(args.out, "w") as fh:
        fh.write("# Physical plans of the registered queries\n\n")
        fh.write(f"Generated by `tools/plan_report.py` at `{args.sf_dir}` on local[8] "
                 "(static plans before AQE re-planning). *Eager* lists the tables a "
                 "query writes under `spark.checkpoint.dir` while it is built (sorted "
                 "stages, offset/carry summaries, landed tables), *eager shuffles* the "
                 "exchanges of the jobs that write them.\n\n")
        fh.write("| query | shuffles | partitioning | broadcasts | scalar subqueries | "
                 "scans | Python stages | eager shuffles | eager stages |\n")
        fh.write("| --- | --- | --- | --- | --- | --- | --- | --- | --- |\n")
        for r in rows:
            fh.write("| " + " | ".join(str(x) for x in r[:9]) + " |\n")
        fh.write("\n## Plan trees\n")
        for r in rows:
            fh.write(f"\n### {r[0]}\n\n```\n{r[9].strip()}\n```\n")
    print(f"wrote {args.out}")


if __name__ == "__main__":
    main()
