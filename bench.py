"""Benchmark: run the headline query keys and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set below).
Each query is executed in full into Spark's ``noop`` sink (no collect to the
driver); the wall time of that action is recorded.  Queries run once to warm
the JVM on a small table, then once timed.  ``headline_csv_load`` is the
counterpart of the reference's one Spark figure (its headline CSV load): the
headlines are written as CSV snapshots before timing, and the timed run
scans them and runs the whole headline pipeline.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "headline_csv_load", "headline_clean", "news_window", "company_context", "reporting_dates", "pit_asof", "statement_matrix",
    "pit_dataset", "eps_compare", "strategy_leaderboard", "trade_report", "earnings_report", "position_state",
    "long_short", "event_backtest", "yearly_performance", "quantile_returns", "prompt_table", "batch_score",
    "training_set", "committee_consensus", "chunk_assign",
]


def _headline_csv_load(spark, sf_dir):
    from pyspark.sql import functions as F

    from pitwise.operators import news
    from pitwise.plans import fixtures as fx
    from pitwise.plans.q_news import START
    from pitwise.session import scratch_path
    from pitwise.sources import headlines as hl

    path = scratch_path(spark, "bench-headlines-csv")
    hl.write_headline_csv(fx.v_headlines(spark, sf_dir).repartition(F.to_date("arrival")), path)

    def build(spark, d):
        raw = hl.to_canonical(hl.read_headline_csv(spark, path, glob="*.csv"))
        return news.build_news_dataset(raw, fx.v_universe(spark, d), START)

    return build


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from pitwise.plans import catalog
    from pitwise.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="pitwise-bench")
    catalog.load_all()
    qs = catalog.QUERIES

    # warm-up: JIT, Python workers, parquet footers
    warm = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir
    for n in ("headline_clean", "event_backtest"):
        qs[n](spark, warm).write.format("noop").mode("overwrite").save()

    # The reference's one Spark figure is its headline CSV load.  The
    # snapshots are written as CSV once (untimed); the timed key scans them
    # and runs the whole headline pipeline (filter, both dedupes, clean, sort).
    qs = dict(qs)
    qs["headline_csv_load"] = _headline_csv_load(spark, sf_dir)

    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_wall_time_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
