"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the input folder, BENCH_CPUS the number of local cores. The panels are built from
the base tables and stored first; their building is timed as the ``panel_*`` entries. Each query
then runs from the stored panel to its last row into the no-op sink. Each time is the median of
BENCH_RUNS runs; the fitted wide chain, which takes minutes, runs once, for BENCH_CHAIN_SECONDS at most (left out beyond).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import threading
import time

from pyspark.sql import DataFrame, SparkSession

from paneleffect.plans import wide
from paneleffect.registry import BOOK, panels

HEADLINE = (
    "a1_monthly_totals",
    "a6_profile",
    "a8_z_outliers",
    "f7_checklist_fine",
    "w1_w3_history_fine",
    "w4_percent_other",
    "w8_adstock_fine",
    "a11_correlations",
    "a22_dedupe_non_personal",
    "j4_substitute_actions",
    "c5_incremental_action",
    "c6_incremental_outcome",
    "a19_observed_vs_incremental",
    "m11_auc",
)


def wide_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole wide chain on the dense panel, ids and full fits included; nothing is kept from before."""
    run = wide.run(panels.dense(spark, sf_dir))
    return run.action_monthly.join(run.outcome_monthly, "month")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paneleffect-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    BOOK.queries["a1_monthly_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}

    def clock(name: str, query, runs: int = runs) -> None:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)

    for name, build in panels.BUILDERS.items():
        clock(f"panel_{name}", build)
        panels.stored(spark, sf_dir, name)
    for name in names:
        clock(name, BOOK.queries[name])
    if "m11_auc" in names:
        limit = float(os.environ.get("BENCH_CHAIN_SECONDS", "300"))
        stop = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
        stop.start()
        try:
            clock("m15_wide_chain", wide_chain, 1)
        except Exception as cancelled:  # the other times are reported all the same
            print(f"m15_wide_chain did not end within {limit:.0f} s: {type(cancelled).__name__}", file=sys.stderr)
        stop.cancel()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
