"""Reporting calendar, universes and index membership (AGG1-5, WIN5, JN4-5, JN9, JN16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.sizing import broadcast_bounded


def keep_universe(df: DataFrame, universe: DataFrame, key: str, universe_key: str | None = None) -> DataFrame:
    """JN5: rows whose key is a universe member (semi join; the universe is
    broadcast by the planner only under its size threshold)."""
    u = universe.select(F.col(universe_key or key).alias(key)).distinct()
    return df.join(u, key, "left_semi")


def universe_minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """JN4/SET2: members of ``a`` that are not in ``b``."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def reporting_dates(reports: DataFrame, start=None, *, id_col: str = "id", skip_first: bool = False) -> DataFrame:
    """AGG1 + FLT4 + FLT5 + SRT2: the first report date per (security, period end).

    ``min`` is associative, so one grouped pass (partial aggregation before
    the shuffle) replaces the reference's per-rebalance loop and its union.
    ``skip_first`` drops the earliest reporting date, as the reference's
    dataset loop does (K1; off by default: all dates are kept).
    """
    out = reports.groupBy(id_col, "period_end").agg(F.min("as_of").alias("as_of"))
    out = out.na.drop("any")
    if start is not None:
        out = out.where(F.col("as_of") >= F.lit(start).cast("date"))
    if skip_first:
        out = out.where(F.col("as_of") > out.select(F.min("as_of")).scalar())
    return out.select("as_of", id_col, "period_end")


def unique_securities(calendar: DataFrame, col: str = "id") -> DataFrame:
    """AGG2: distinct securities (or FIGIs with ``col='figi'``)."""
    return calendar.select(col).distinct()


def reporting_calendar(calendar: DataFrame) -> DataFrame:
    """AGG3: distinct reporting dates, ascending."""
    return calendar.select("as_of").distinct().orderBy("as_of")


def total_securities(calendar: DataFrame) -> DataFrame:
    """AGG4: number of (date, security) records (no ticker-root de-duplication, K21)."""
    return calendar.select("as_of", "id").distinct().agg(F.count("*").alias("n_records"))


def securities_by_date(calendar: DataFrame, on_date=None) -> DataFrame:
    """FLT14 + AGG5: sorted securities reporting on each date (or one date;
    an unknown date gives an empty frame, K6).  A list holds one day's
    reporters only."""
    c = calendar.select("as_of", "id").distinct()
    if on_date is not None:
        c = c.where(F.col("as_of") == F.lit(on_date).cast("date"))
    return c.groupBy("as_of").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def ticker_root(id_col) -> "F.Column":
    """SC1: the ticker root, the first space-separated token."""
    return F.substring_index(id_col, " ", 1)


def ticker_root_dedup(calendar: DataFrame, seq_col: str = "seq") -> DataFrame:
    """WIN5: one listing per (date, ticker root), the first by ``seq`` kept.

    Written as a grouped ``min(struct(seq, ...))`` (partial aggregation) so a
    root with many listings is reduced before the shuffle."""
    from pitwise.operators.news import first_per_key

    return first_per_key(calendar, ["as_of", ticker_root(F.col("id"))], [seq_col])


def date_security_pairs(calendar: DataFrame) -> DataFrame:
    """JN16: every (date, security) pair to score: the key set of the calendar (no cross join)."""
    return calendar.select(F.col("as_of").alias("date"), F.col("id").alias("security")).distinct()


def index_members(members: DataFrame, rebalance_dates: DataFrame) -> DataFrame:
    """JN9: members of each index on each rebalance date:
    ``start_date <= d and (end_date is null or end_date > d)``.

    The range join is an equi-join on (year): each membership is exploded to
    the calendar years it spans, clipped to the first and last rebalance
    year (scalar subqueries over the rebalance dates, so an open membership
    reaches exactly the last rebalance date), each rebalance date carries
    its year, then the exact bounds are checked.
    """
    ry = rebalance_dates.select(F.year("rebalance_date").alias("y"))
    lo = F.greatest(F.year("start_date"), ry.select(F.min("y")).scalar())
    hi = F.least(F.year("end_date"), ry.select(F.max("y")).scalar())  # least() skips a NULL (open) end
    m = members.where(lo <= hi).withColumn("__yr", F.explode(F.sequence(lo, hi)))
    # rebalance dates are at most one row per day: broadcast, so memberships of
    # a busy year are never gathered on one shuffle key
    r = broadcast_bounded(rebalance_dates.select(F.col("rebalance_date"), F.year("rebalance_date").alias("__yr")))
    j = m.join(r, "__yr").where(
        (F.col("start_date") <= F.col("rebalance_date"))
        & (F.col("end_date").isNull() | (F.col("end_date") > F.col("rebalance_date")))
    )
    return j.select("index_id", "rebalance_date", "id")
