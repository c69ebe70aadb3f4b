"""Trade events to long/short portfolio weights (JN2, JN7, FLT12, AGG13, JN11,
WIN9, WIN10, U1-U3).

Everything is long form ``(date, security, weight)``; a dates x securities
matrix is never built.  Windows are per security and ordered by date, so a
partition holds one security's calendar (trades are first reduced to one
row per security and day), never a data-sized group.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.sizing import broadcast_bounded

# Decision words and weighting schemes of the reference.
BUY, SELL, HOLD, MISSING = "BUY", "SELL", "HOLD", "Missing"
LONG, SHORT = "LONG", "SHORT"
EQUAL, PROPORTIONAL = "EQUAL", "PROPORTIONAL"


def map_to_figi(trades: DataFrame, securities: DataFrame, sec_col: str = "security") -> DataFrame:
    """JN2: attach the FIGI of each traded security (inner join; of several
    FIGIs of one ticker the least, so none fans out or changes between runs)."""
    dim = securities.groupBy(F.col("id").alias(sec_col)).agg(F.min("figi").alias("figi"))
    return trades.join(dim, sec_col)


def trading_grid(keys: DataFrame, calendar: DataFrame, end, *, key: str = "security", start_col: str = "start") -> DataFrame:
    """(date, key) for every trading day from the key's own start to ``end``.

    Generated per key with ``sequence`` and matched to the trading calendar
    by an equi-join on date (no cross join); the calendar is a small,
    date-bounded table (one row per day), so it is broadcast."""
    days = keys.select(key, F.explode(F.sequence(F.col(start_col).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.join(broadcast_bounded(calendar.select("date").distinct()), "date")


def position_state(trades: DataFrame, calendar: DataFrame, end) -> DataFrame:
    """JN7 + FLT12: LONG/SHORT state per trading day from the first directional
    trade of each security.  HOLD and Missing change nothing; trades apply in
    file order (``seq``), each overwriting from its date on, so the state on a
    day is the decision of the highest-``seq`` trade dated on or before it (K9).
    """
    t = trades.where(F.col("decision").isin(BUY, SELL))
    is_buy = F.when(F.col("decision") == BUY, F.lit(1)).otherwise(F.lit(0))
    # fixed-width buffers: a hash aggregate per (security, day)
    per_day = t.groupBy("security", "date").agg(F.max("seq").alias("__seq"), F.max_by(is_buy, "seq").alias("__buy"))
    first = per_day.groupBy("security").agg(F.min("date").alias("start"))
    grid = trading_grid(first, calendar, end).select(
        "security", "date", F.lit(None).cast("long").alias("__seq"), F.lit(None).cast("int").alias("__buy"),
        F.lit(1).alias("__kind"))
    u = per_day.select("security", "date", F.col("__seq").cast("long").alias("__seq"), "__buy",
                       F.lit(0).alias("__kind")).unionByName(grid)
    w = Window.partitionBy("security").orderBy("date", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    s = u.withColumn("__run", F.max_by("__buy", "__seq").over(w)).where(
        (F.col("__kind") == 1) & F.col("__run").isNotNull())
    state = F.when(F.col("__run") == 1, LONG).otherwise(SHORT)
    return s.select("date", "security", state.alias("state"))


def _scheme_weight(scheme, signal: Column, long_leg: bool) -> Column:
    if callable(scheme):
        params = inspect.signature(scheme).parameters
        kw = {}
        if "signal" in params:
            kw["signal"] = signal
        if "long_leg" in params:
            kw["long_leg"] = long_leg
        w = scheme(**kw).cast("double")
        # U2: magnitudes must be non-negative or NULL
        return F.when(w < 0, F.raise_error(F.lit("weighting scheme returned a negative weight"))).otherwise(w)
    if scheme == EQUAL:
        return F.when(signal.isNotNull(), F.lit(1.0))
    if scheme == PROPORTIONAL:
        return signal.cast("double")
    raise ValueError(f"unsupported weighting scheme: {scheme!r}")


def leg_portfolio(
    positions: DataFrame,
    long_leg: bool,
    scheme: str | Callable = EQUAL,
    signal: DataFrame | None = None,
) -> DataFrame:
    """AGG13: one leg's weights, ``w / (sign * sum(w))`` per date.

    ``signal`` is ``(date, security, signal)``; without it the signal is 1
    (as in the reference's event backtest).  The per-date total is a grouped
    sum joined back, so a date with many holdings is summed with partial
    aggregation instead of one window partition, and the totals (one row per
    day) are broadcast back.  A day whose total is 0
    or NULL gives NULL weights (K10)."""
    leg = positions.where(F.col("state") == (LONG if long_leg else SHORT)).select("date", "security")
    if signal is not None:
        leg = leg.join(signal.select("date", "security", "signal"), ["date", "security"], "left")
    else:
        leg = leg.withColumn("signal", F.lit(1.0))
    leg = leg.withColumn("__w", _scheme_weight(scheme, F.col("signal"), long_leg))
    tot = leg.groupBy("date").agg(F.sum("__w").alias("__tot"))  # partial aggregation per day
    sign = 1.0 if long_leg else -1.0
    j = leg.join(broadcast_bounded(tot), "date")  # one row per day
    return j.select("date", "security", F.try_divide(F.col("__w"), F.lit(sign) * F.col("__tot")).alias("weight"))


def checked_signal(signal: DataFrame, calendar: DataFrame) -> DataFrame:
    """U1: a user's signal ``(security, date, signal[, published])``, checked
    while the query runs: an error for a row without security or date, a value
    that is NaN, several rows of one (security, date), a date that is no
    trading day, and a value ``published`` after its date.  A NULL signal holds
    nothing that day."""
    published = F.col("published").cast("date") if "published" in signal.columns else F.lit(None).cast("date")
    g = signal.groupBy("security", F.col("date").cast("date").alias("date")).agg(
        F.count("*").alias("__n"), F.max(F.col("signal").cast("double")).alias("__s"), F.max(published).alias("__p"))
    days = broadcast_bounded(calendar.select("date", F.lit(True).alias("__open")).distinct())  # one row per day
    where = F.concat_ws(" ", F.lit(" at"), "security", F.col("date").cast("string"))
    fail = lambda text: F.raise_error(F.concat(F.lit(text), where))
    value = (
        F.when(F.col("security").isNull() | F.col("date").isNull(), fail("signal without security or date"))
        .when(F.col("__n") > 1, fail("several signals"))
        .when(F.col("__open").isNull(), fail("signal on a day without trading"))
        .when(F.col("__p") > F.col("date"), fail("signal uses data published later"))
        .when(F.isnan("__s"), fail("signal is no number"))
        .otherwise(F.col("__s")))
    return g.join(days, "date", "left").select("security", "date", value.alias("signal"))


#: (weight held yesterday, today's target, the security's own state) -> weight held today
PortfolioFn = Callable[[float, float, dict], float]


def turnover_limit(limit: float) -> PortfolioFn:
    """Moves a weight towards its target by at most ``limit`` a day."""
    return lambda held, target, state: held + max(-limit, min(limit, target - held))


def user_portfolio(weights: DataFrame, calendar: DataFrame, end, fn: PortfolioFn) -> DataFrame:
    """U3: weights held day by day under a user's rule, ``(date, security, weight)``.

    Per security, in date order from its first target to ``end``, ``fn`` gets
    yesterday's weight (0 at first), today's target (0 without one, or a NULL
    one) and a dict that it may keep from day to day.  A group holds one
    security's trading days, which the calendar bounds; the rule sees no other
    security.  A weight that is no finite number is an error.  Rows without
    security or date are left out; of several targets of one day their sum is."""
    targets = weights.where(F.col("security").isNotNull() & F.col("date").isNotNull()).groupBy("security", "date").agg(F.sum("weight").alias("target"))
    grid = trading_grid(targets.groupBy("security").agg(F.min("date").alias("start")), calendar, end).select("security", "date")
    days = grid.join(targets, ["security", "date"], "left")

    def held(rows):
        rows = rows.sort_values("date")
        out, now, state = [], 0.0, {}
        for target in rows["target"].fillna(0.0):
            now = float(fn(now, float(target), state))
            if not math.isfinite(now):
                raise ValueError("the portfolio function returned no finite weight")
            out.append(now)
        return rows.assign(weight=out)[["date", "security", "weight"]]

    schema = f"date date, security {weights.schema['security'].dataType.simpleString()}, weight double"
    return days.groupBy("security").applyInPandas(held, schema)


def long_short(long_w: DataFrame, short_w: DataFrame) -> DataFrame:
    """JN11: combine the legs; a side missing counts as 0 (long form: rows
    exist only where at least one leg holds the security)."""
    u = long_w.unionByName(short_w)
    return u.groupBy("date", "security").agg(F.sum("weight").alias("weight"))


def build_port_weights(trades: DataFrame, calendar: DataFrame, end, scheme=EQUAL, signal=None) -> DataFrame:
    """DOM12: trades -> position state -> equal-weighted long and short legs -> long/short."""
    pos = position_state(trades, calendar, end)
    return long_short(leg_portfolio(pos, True, scheme, signal), leg_portfolio(pos, False, scheme, signal))


def lag_weights(weights: DataFrame, calendar: DataFrame, lag: int = 1, key: str = "security") -> DataFrame:
    """WIN9: weights decided at the close of trading day ``i`` apply on day
    ``i + lag`` (exact trading days via the calendar index)."""
    cal = broadcast_bounded(calendar.select("date", "idx").distinct())
    w = weights.join(cal, "date").select(key, (F.col("idx") + lag).alias("idx"), *[
        c for c in weights.columns if c not in ("date", key)])
    return w.join(cal, "idx").drop("idx")


def rebalance_anchor(calendar: DataFrame, freq: str = "D", rebalance_dates: DataFrame | None = None) -> DataFrame:
    """Calendar day -> the rebalance day whose weights it holds.

    ``D``: every day; ``W``/``M``/``Q``: the last trading day of each week /
    month / quarter, held until the next one.  ``rebalance_dates`` (first
    column, e.g. the distinct event dates; the reference's
    ``use_trading_dts``) replaces the frequency: weights change only on those
    days, or on the next trading day of an event between trading days.
    Computed on the calendar (one row per day), so the windows here are over
    days only."""
    cal = calendar.select("date").distinct()
    if rebalance_dates is not None:
        # distinct dates: at most one row per day, so a bounded broadcast
        r = rebalance_dates.select(F.col(rebalance_dates.columns[0]).cast("date").alias("date")).distinct()
        days = cal.select("date", F.col("date").alias("__t"), F.lit(False).alias("__event")).unionByName(
            r.select("date", F.lit(None).cast("date").alias("__t"), F.lit(True).alias("__event")))
        # the trading day itself sorts after an event of that day
        ahead = Window.orderBy("date", F.col("__event").desc()).rowsBetween(0, Window.unboundedFollowing)
        r = days.select("__event", F.min("__t").over(ahead).alias("__r")).where("__event").select("__r").distinct()
        j = cal.join(broadcast_bounded(r), cal["date"] == r["__r"], "left")
    elif freq == "D":
        return cal.select("date", F.col("date").alias("anchor"))
    else:
        unit = {"W": "week", "M": "month", "Q": "quarter"}[freq]
        bucket = F.date_trunc(unit, "date")
        last = cal.groupBy(bucket.alias("__b")).agg(F.max("date").alias("__r"))
        j = cal.join(last, cal["date"] == last["__r"], "left")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("date", F.max("__r").over(w).alias("anchor")).where(F.col("anchor").isNotNull())


def rebalance_hold(weights: DataFrame, calendar: DataFrame, freq: str = "D", key: str = "security",
                   rebalance_dates: DataFrame | None = None) -> DataFrame:
    """WIN10: weights only change on rebalance days and are held in between."""
    a = broadcast_bounded(rebalance_anchor(calendar, freq, rebalance_dates))
    w = weights.withColumnRenamed("date", "anchor")
    return w.join(a, "anchor").drop("anchor").select("date", key, *[c for c in weights.columns if c not in ("date", key)])
