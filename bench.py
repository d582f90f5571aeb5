"""Wall seconds of the workload's benchmark queries, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, str(ROOT))


def main() -> None:
    from pyspark.sql import SparkSession

    from opalgrid.plans import workload

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = workload.queries()
    names = [n for n in queries if n.startswith("bench_")] + ["filter_q15", "sort_q18", "filter_sort_q26", "join_sort_q42", "join_sort_q47", "join_sort_q49", "multi_key_join", "stats_lineitem"]
    seconds = {}
    for name in names:
        taken = []
        for _ in range(3):
            began = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - began)
        seconds[name] = round(statistics.median(taken), 4)
    spark.stop()
    print(json.dumps({"metric": "workload_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
