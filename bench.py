"""Wall time of the headline queries; one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the threads."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from pitchlake.plans import catalogue  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["unpivot_long", "rank_by_record", "team_stats_e2", "off_def_raw", "adjusted_goals", "performance_layer", "power_e1", "sos_baseline", "sos_relax_3", "power_e2", "rank_national", "rank_state", "history_enriched", "components", "top3_opponents", "events_hourly"]


def main() -> None:
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", own).config("spark.sql.warehouse.dir", f"{own}/warehouse").config("spark.checkpoint.dir", f"file://{own}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # starts the JVM's code, not timed
    taken = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()  # no query starts from another's tables
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
