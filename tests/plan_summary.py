"""Run every registered query with Spark's event log on and summarise the plans
of all its jobs, intermediate ones included, into PLANS.md.

    python tests/plan_summary.py /root/testdata/sf0.01 > PLANS.md
"""

from __future__ import annotations

import json
import re
import sys
import tempfile
import time
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

PYTHON = re.compile(r"Python|Pandas|Arrow")


def nodes_of(info: dict):
    yield info["nodeName"].split(" (")[0].strip(), info["simpleString"]
    for child in info["children"]:
        yield from nodes_of(child)


def run_all(sf: str, folder: str, only: list[str]) -> list[tuple[str, float, float]]:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.maxMetadataStringLength", "400")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{folder}").config("spark.eventLog.compress", "false")
             .config("spark.eventLog.rolling.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spans = []
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        t0 = time.time() * 1000
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        spans.append((name, t0, time.time() * 1000))
    spark.stop()
    return spans


def plans_of(folder: str, spans) -> dict[str, list[dict]]:
    """The last plan (after adaptive changes) of every execution of a query."""
    last, began = {}, {}
    for path in Path(folder).iterdir():
        for line in path.open():
            if '"sparkPlanInfo"' in line:
                e = json.loads(line)
                last[e["executionId"]] = e["sparkPlanInfo"]
                if "time" in e:
                    began[e["executionId"]] = e["time"]
    out = defaultdict(list)
    for k, info in last.items():
        for name, t0, t1 in spans:
            if t0 <= began.get(k, 0) <= t1:
                out[name].append(info)
    return out


def summary(plans: list[dict]) -> str:
    c, joins, python = Counter(), Counter(), Counter()
    for info in plans:
        for node, text in nodes_of(info):
            c[node] += 1
            c["single"] += node == "Exchange" and "SinglePartition" in text
            if "Join" in node or node == "CartesianProduct":
                joins[node] += 1
            if PYTHON.search(node):
                python[node] += 1
    listed = lambda x: ", ".join(f"{n} {k}" for k, n in sorted(x.items())) or "-"
    return (f"{len(plans)} | {c['Exchange']} | {c['single']} | {c['BroadcastExchange']} | {c['Window'] + c['WindowGroupLimit']} | "
            f"{listed(joins)} | {listed(python)}")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    folder = tempfile.mkdtemp(prefix="plans-")
    spans = run_all(sf, folder, sys.argv[2:])
    plans = plans_of(folder, spans)
    print("# Physical plans of all registered queries\n")
    print(f"Made by `tests/plan_summary.py {sf}` from Spark's event log: the final plans, after adaptive changes, of every execution of a query - "
          "checkpoints, counts and collects as well as the result. `single`: exchanges into one partition (global aggregates, one-row results, "
          "top-N). Small inputs make adaptive execution turn shuffle joins into broadcast joins; the size checks in the code do not depend on it.\n")
    print("| query | executions | exchanges | single | broadcasts | windows | joins | Python |")
    print("|---|---|---|---|---|---|---|---|")
    for name, _, _ in spans:
        print(f"| {name} | {summary(plans[name])} |")


if __name__ == "__main__":
    main()
