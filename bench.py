"""Headline queries, timed end to end; prints one JSON line.

Names ending in ``_stored`` run on bars saved beforehand, which is how bars are
used night after night; all others build what they need from the raw tables.

``BENCH_SF_DIR`` names the data (default /root/testdata/sf0.1), ``BENCH_CPUS``
the cores (default 8), ``BENCH_RUNS`` the timed runs per query after one
warm-up (default 1). The value is the sum of the median times.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame

from updraft.operators.grid import config_grid
from updraft.operators.sweep import sweep_screen
from updraft.plans.inputs import part_month_bars
from updraft.plans.screening import screen
from updraft.plans.workload import GRID, LOOSE, QUERIES, TURNOVER_AVG, TWO_TIER
from updraft.session import build_session, scratch_dir

HEADLINE = (
    "bars_part_month", "bars_supplier_week", "streak_metrics", "screen_volume_all",
    "screen_volume_avg", "screen_turnover_all", "screen_published", "report_rows", "data_period",
    "config_grid", "sweep_metrics", "sweep_screen", "upsert_latest", "ingest_guard",
    "latest_trading_day", "freshness_by_code", "fetch_plan_by_code", "theme_history", "theme_cards",
    "theme_pivot", "screen_sliced_ranks", "screen_recent_first", "sweep_carry_forward",
    "stream_upsert", "wide_to_long",
)


STORED = {
    "screen_volume_stored": lambda bars: screen(bars, LOOSE),
    "screen_turnover_avg_stored": lambda bars: screen(bars, TURNOVER_AVG),
    "screen_default_stored": lambda bars: screen(bars),
    "sweep_screen_stored": lambda bars: sweep_screen(bars, TWO_TIER),
    "config_grid_stored": lambda bars: config_grid(bars, GRID),
}


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "updraft-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    stored_path = scratch_dir(spark, "bench")
    part_month_bars(spark, sf_dir).write.parquet(stored_path)

    jobs = {name: lambda name=name: QUERIES[name](spark, sf_dir) for name in HEADLINE}
    for name, query in STORED.items():
        jobs[name] = lambda query=query: query(spark.read.parquet(stored_path))
    times = {}
    for name, job in jobs.items():
        laps = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            drain(job())
            laps.append(time.perf_counter() - start)
        times[name] = round(statistics.median(laps[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
