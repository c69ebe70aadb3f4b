"""Broadcast policy.

Sides whose size grows with the data (security dimensions, universes,
metadata) are joined without a hint: Spark's planner broadcasts them only
when its size estimate is under ``spark.sql.autoBroadcastJoinThreshold``,
and AQE re-plans from the measured shuffle output at run time; beyond the
threshold the join stays a shuffle join.  An explicit hint is used only for
tables whose row count is bounded by construction, never by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_bounded(df: DataFrame) -> DataFrame:
    """Broadcast a side whose row count is bounded by construction, not by
    the data volume: one row per calendar day (trading calendar, per-day
    totals, rebalance dates), per (day, period) pair, or per partition.  A
    century of days is ~36.6k rows, a few MB, at any input scale."""
    return F.broadcast(df)


def by_security(df: DataFrame, col: str = "id") -> DataFrame:
    """Deal rows by security, over as many tasks as a shuffle has partitions.

    For a side whose join gives many times the rows of its inputs: by the size
    of what is shuffled AQE would put several partitions into one task, which
    then has to hold the many rows of all of them.  A given number keeps the
    partitions apart; it is the one Spark takes for its own shuffles."""
    conf = df.sparkSession.conf
    n = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions")
    return df.repartition(int(n), col)
