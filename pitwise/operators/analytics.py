"""Prices, returns and backtest analytics (WIN7-8, WIN11-12, JN13-14,
AGG18-20, DOM13).  Formulas the reference delegates are fixed in
SURVEY §7.3: weights at the close of day d earn the return of day
d + lag; cumulative return is ``exp(sum(log1p r)) - 1``; yearly figures use
``sqrt(252)`` annualisation and a zero risk-free rate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwise.operators import portfolio as pf
from pitwise.operators.asof import asof_join

TRADING_DAYS = 252
ROLLING_SHARPE_WINDOW = 63
N_QUANTILES = 5
INDUSTRY_LEVELS = ("level_1", "level_2", "level_3", "level_4")
UNCLASSIFIED = "unclassified"


def forward_fill(series: DataFrame, calendar: DataFrame, end, value: str, *, key: str = "id") -> DataFrame:
    """WIN7: a (key, date, value) series on every trading day from the key's
    first observation to ``end``, gaps filled with the last value
    (``last(ignorenulls)`` over the key's own days).  Observations of other
    days (weekends, holidays) are carried to the next trading day: they and
    the trading days are ordered together, observations first on a day.  Of
    several observations of one day the greatest counts."""
    first = series.groupBy(key).agg(F.min("date").alias("start"))
    grid = pf.trading_grid(first, calendar, end, key=key).select(key, "date", F.lit(1).alias("__kind"))
    seen = series.select(key, "date", F.lit(0).alias("__kind"), value)
    w = Window.partitionBy(key).orderBy("date", "__kind", value).rowsBetween(Window.unboundedPreceding, 0)
    u = seen.unionByName(grid, allowMissingColumns=True).select(
        key, "date", "__kind", F.last(value, ignorenulls=True).over(w).alias(value))
    return u.where(F.col("__kind") == 1).select(key, "date", value)


def weekly_to_daily(weekly: DataFrame, calendar: DataFrame, end, value: str = "beta", key: str = "id") -> DataFrame:
    """WIN8: a weekly series (stamped on its last observation day) forward
    filled to the daily calendar."""
    return forward_fill(weekly.select(key, "date", value), calendar, end, value, key=key)


def daily_returns(prices: DataFrame, key: str = "id", px: str = "px") -> DataFrame:
    """WIN12: ``px / lag(px) - 1`` per key over its trading days."""
    w = Window.partitionBy(key).orderBy("date")
    r = F.try_divide(F.col(px), F.lag(px).over(w)) - 1
    return prices.select(key, "date", r.alias("ret")).where(F.col("ret").isNotNull())


def total_return_prices(prices: DataFrame, actions: DataFrame, key: str = "id", px: str = "px") -> DataFrame:
    """Prices ``(id, date, px)`` adjusted backwards for corporate actions
    ``(id, ex_date, dividend, split)``, so that their returns are total returns.

    An action scales all prices before its ex-date by
    ``(1 - dividend / last price before it) / split`` (split: new shares for one
    old; dividend per old share).  Of several actions of one day dividends add
    up and splits multiply.  A null or non-positive split is none, and so is a
    dividend that is null, not positive, not below that price, or before the
    first one.  Actions without prices give no rows; null prices stay null.
    The factors multiply as a running sum of logarithms over a security's own
    days, newest first.  Adjusted prices know later actions: a signal must be
    built on the prices as they were."""
    split = F.when(F.col("split") > 0, F.log("split")).otherwise(0.0)
    dividend = F.when(F.col("dividend") > 0, F.col("dividend")).otherwise(0.0)
    a = actions.groupBy(key, F.col("ex_date").alias("date")).agg(F.sum(split).alias("__split"), F.sum(dividend).alias("__div"))
    # an action comes before the prices of its day
    days = prices.select(key, "date", px, F.lit(1).alias("__kind")).unionByName(
        a.select(key, "date", F.lit(0).alias("__kind"), "__split", "__div"), allowMissingColumns=True)
    own = Window.partitionBy(key).orderBy("date", "__kind", px)
    last = F.last(px, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    paid = F.when(F.col("__div") < F.col("__last"), F.log1p(-F.col("__div") / F.col("__last"))).otherwise(0.0)
    factor = F.when(F.col("__kind") == 0, paid - F.col("__split"))
    later = F.sum("__factor").over(own.rowsBetween(1, Window.unboundedFollowing))
    d = days.withColumn("__last", last).withColumn("__factor", factor).withColumn("__later", later)
    return d.where(F.col("__kind") == 1).select(key, "date", (F.col(px) * F.exp(F.coalesce("__later", F.lit(0.0)))).alias(px))


def weighted_return(weights: DataFrame, returns: DataFrame, name: str, *, key: str = "security", ret_key: str = "id") -> DataFrame:
    """JN13: ``sum(w * r)`` per date (missing return = 0)."""
    r = returns.select(F.col(ret_key).alias(key), "date", "ret")
    j = weights.join(r, [key, "date"], "left")
    return j.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce(F.col("ret"), F.lit(0.0))).alias(name))


def portfolio_returns(weights: DataFrame, bench_weights: DataFrame, returns: DataFrame, calendar: DataFrame,
                      *, lag: int = 1, start=None, end=None) -> DataFrame:
    """Strategy and benchmark daily returns on every trading day in [start, end]
    (no holdings = 0 return).  Both weight sets are lagged ``lag`` days."""
    sw = pf.lag_weights(weights, calendar, lag)
    bw = pf.lag_weights(bench_weights, calendar, lag)
    s = weighted_return(sw, returns, "strategy_return")
    b = weighted_return(bw, returns, "benchmark_return")
    days = calendar.select("date")
    if start is not None:
        days = days.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.where(F.col("date") <= F.lit(end).cast("date"))
    out = days.join(s, "date", "left").join(b, "date", "left")  # all three: one row per day
    return out.select("date", F.coalesce("strategy_return", F.lit(0.0)).alias("strategy_return"),
                      F.coalesce("benchmark_return", F.lit(0.0)).alias("benchmark_return"))


def _cum(col: str, w) -> F.Column:
    wealth = F.exp(F.sum(F.log1p(F.col(col))).over(w)) - 1
    return F.when(F.min(F.col(col)).over(w) <= -1, F.lit(-1.0)).otherwise(wealth)


def cumulative_returns(daily: DataFrame, cols=("strategy_return", "benchmark_return"), by=("run_name",)) -> DataFrame:
    """AGG18: compounded return to date per run (window per run, by date)."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily
    for c in cols:
        out = out.withColumn(c.replace("_return", "_cum"), _cum(c, w))
    return out


def yearly_performance(daily: DataFrame, col: str, by=("run_name",)) -> DataFrame:
    """AGG19: per run and calendar year: compounded return, annualised
    volatility and Sharpe, max drawdown within the year, hit rate.  Volatility
    and Sharpe are NULL when n < 2 or the deviation is 0.  After a return of
    -1 or less nothing is left: total return and drawdown are -1."""
    keys = list(by) + ["year"]
    d = daily.withColumn("year", F.year("date"))
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__wealth", _cum(col, w) + 1)
    d = d.withColumn("__dd", F.col("__wealth") / F.greatest(F.max("__wealth").over(w), F.lit(1.0)) - 1)
    sd = F.stddev_samp(col)
    ok = (F.count(col) >= 2) & (sd > 0)
    return d.groupBy(*keys).agg(
        F.count(col).alias("n_days"),
        F.when(F.min(col) <= -1, F.lit(-1.0)).otherwise(F.exp(F.sum(F.log1p(F.col(col)))) - 1).alias("total_return"),
        F.when(ok, sd * math.sqrt(TRADING_DAYS)).alias("volatility"),
        F.when(ok, F.avg(col) / sd * math.sqrt(TRADING_DAYS)).alias("sharpe"),
        F.min("__dd").alias("max_drawdown"),
        F.avg((F.col(col) > 0).cast("double")).alias("hit_rate"),
    )


def rolling_sharpe(daily: DataFrame, col: str, n: int = ROLLING_SHARPE_WINDOW, by=("run_name",)) -> DataFrame:
    """WIN11: Sharpe over the last ``n`` days, NULL until ``n`` days exist."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(-(n - 1), 0)
    sd = F.stddev_samp(col).over(w)
    val = F.when((F.count(col).over(w) == n) & (sd > 0), F.avg(col).over(w) / sd * math.sqrt(TRADING_DAYS))
    return daily.select(*by, "date", val.alias("rolling_sharpe"))


def descriptive_stats(daily: DataFrame, col: str, by=("run_name",)) -> DataFrame:
    """AGG20: mean, sample deviation, (population) skewness and excess kurtosis, min, max."""
    return daily.groupBy(*by).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("stddev"),
        F.skewness(col).alias("skewness"), F.kurtosis(col).alias("kurtosis"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )


def quantile_returns(returns: DataFrame, n: int = N_QUANTILES, key: str = "id") -> DataFrame:
    """AGG20: securities bucketed by today's return (``ntile`` per date, ties
    by id) and the mean next-day return per bucket.  A date's partition
    holds that day's universe only."""
    w = Window.partitionBy(key).orderBy("date")
    r = returns.withColumn("fwd", F.lead("ret").over(w)).where(F.col("fwd").isNotNull())
    b = r.withColumn("bucket", F.ntile(n).over(Window.partitionBy("date").orderBy("ret", key)))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd_return"))


def industry_exposure(weights: DataFrame, industries: DataFrame, *, levels=INDUSTRY_LEVELS, valid_from: str = "valid_from",
                      version=()) -> DataFrame:
    """JN14: net and gross exposure per date and industry level.

    ``industries``: ``(security, valid_from, *levels)``, dated: a weight is
    classified by the last row of its security on or before its date.  What
    has no classification then, or none at a level, counts as UNCLASSIFIED,
    so each level adds up to the whole portfolio."""
    j = asof_join(weights.select("date", "security", "weight"), industries, ["security"], "date", valid_from, list(levels), version=version)
    lv = j.select("date", "weight", F.explode(F.array(*(
        F.struct(F.lit(i + 1).alias("level"), F.coalesce(F.col(c), F.lit(UNCLASSIFIED)).alias("industry")) for i, c in enumerate(levels)))).alias("__l"))
    return lv.groupBy("date", F.col("__l.level").alias("level"), F.col("__l.industry").alias("industry")).agg(
        F.sum("weight").alias("net_weight"), F.sum(F.abs("weight")).alias("gross_weight"))


def sector_exposure(weights: DataFrame, securities: DataFrame) -> DataFrame:
    """JN14 with an undated dimension: level 1 = sector, level 2 =
    sector/nation; holdings without a row count as UNCLASSIFIED."""
    dim = securities.groupBy(F.col("id").alias("security")).agg(F.min(F.struct("sector", "nation")).alias("__c")).select(
        "security", F.col("__c.sector").alias("level_1"),
        F.when(F.col("__c.sector").isNotNull(), F.concat_ws("/", "__c.sector", F.col("__c.nation").cast("string"))).alias("level_2"),
        F.lit("0001-01-01").cast("date").alias("valid_from"))
    return industry_exposure(weights, dim, levels=("level_1", "level_2"))


def benchmark_statistics(daily: DataFrame, col: str = "strategy_return", benchmark: str = "benchmark_return", by=("run_name",)) -> DataFrame:
    """AGG19, benchmark columns: per run and year the benchmark's compounded
    return, volatility and Sharpe, the excess return (difference of the two
    compounded returns), beta, tracking error and information ratio (of the
    daily differences, annualised).  Days count where both returns are there.
    Grouped co-moments, which Spark merges from partial ones; ratios are NULL
    when n < 2 or their deviation is 0."""
    d = daily.where(F.col(col).isNotNull() & F.col(benchmark).isNotNull()).withColumn("year", F.year("date")).withColumn("__e", F.col(col) - F.col(benchmark))
    whole = lambda c: F.when(F.min(c) <= -1, F.lit(-1.0)).otherwise(F.exp(F.sum(F.log1p(F.col(c)))) - 1)
    sd, te, var = F.stddev_samp(benchmark), F.stddev_samp("__e"), F.var_samp(benchmark)
    two = F.count("__e") >= 2
    return d.groupBy(*by, "year").agg(
        F.count("__e").alias("n_days"),
        whole(benchmark).alias("benchmark_return"),
        F.when(two & (sd > 0), sd * math.sqrt(TRADING_DAYS)).alias("benchmark_volatility"),
        F.when(two & (sd > 0), F.avg(benchmark) / sd * math.sqrt(TRADING_DAYS)).alias("benchmark_sharpe"),
        (whole(col) - whole(benchmark)).alias("excess_return"),
        F.when(two & (var > 0), F.covar_samp(col, benchmark) / var).alias("beta"),
        F.when(two & (te > 0), te * math.sqrt(TRADING_DAYS)).alias("tracking_error"),
        F.when(two & (te > 0), F.avg("__e") / te * math.sqrt(TRADING_DAYS)).alias("information_ratio"),
    )


def rolling_benchmark(daily: DataFrame, n: int = ROLLING_SHARPE_WINDOW, col: str = "strategy_return", benchmark: str = "benchmark_return",
                      by=("run_name",)) -> DataFrame:
    """WIN11, benchmark series: over the last ``n`` days the benchmark's
    Sharpe, beta, tracking error and information ratio; NULL until ``n`` days
    with both returns exist or where the deviation is 0.  A window holds one
    run's days."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(-(n - 1), 0)
    excess = F.col(col) - F.col(benchmark)
    full = F.count(excess).over(w) == n
    sd, te, var = F.stddev_samp(benchmark).over(w), F.stddev_samp(excess).over(w), F.var_samp(benchmark).over(w)
    return daily.select(
        *by, "date",
        F.when(full & (sd > 0), F.avg(benchmark).over(w) / sd * math.sqrt(TRADING_DAYS)).alias("benchmark_sharpe"),
        F.when(full & (var > 0), F.covar_samp(col, benchmark).over(w) / var).alias("beta"),
        F.when(full & (te > 0), te * math.sqrt(TRADING_DAYS)).alias("tracking_error"),
        F.when(full & (te > 0), F.avg(excess).over(w) / te * math.sqrt(TRADING_DAYS)).alias("information_ratio"))


def distributed_ntile(df: DataFrame, n: int, group: str, value: str, tie: str, *, cells: int = 256, name: str = "bucket") -> DataFrame:
    """``ntile(n)`` over (partition by group order by value, tie), NULL values
    first, without a window over a whole group.

    A group's values are cut into cells at its approximate quantiles (a
    mergeable summary of bounded size; only the balance depends on it).  Cells
    are counted, a row's rank is its rank within its cell plus the rows of the
    cells before it, and the tile follows from rank and size.  Exact for any
    cut.  Rows of one value share a cell."""
    cuts = df.groupBy(F.col(group).alias("__g")).agg(F.percentile_approx(value, [i / cells for i in range(1, cells)], 10 * cells).alias("__q"))
    placed = df.join(cuts, df[group].eqNullSafe(cuts["__g"]), "left").withColumn(
        "__cell", F.when(F.col(value).isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array_distinct("__q"), lambda q: q < F.col(value))))).drop("__q", "__g")
    counts = placed.groupBy(F.col(group).alias("__g"), F.col("__cell").alias("__c")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy("__g")
    counts = counts.withColumn("__before", F.sum("__n").over(w.orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).withColumn(
        "__size", F.sum("__n").over(w)).drop("__n")
    at = F.row_number().over(Window.partitionBy(group, "__cell").orderBy(value, tie))
    j = placed.withColumn("__at", at)
    j = j.join(counts, j[group].eqNullSafe(counts["__g"]) & (j["__cell"] == counts["__c"]))
    rank, base, rest = F.col("__at") + F.col("__before") - 1, F.expr(f"__size div {n}"), F.expr(f"__size % {n}")
    long = rest * (base + 1)
    tile = F.when(rank < long, F.floor(F.try_divide(rank, base + 1))).otherwise(rest + F.floor(F.try_divide(rank - long, base))) + 1
    return j.withColumn(name, tile.cast("int")).select(*df.columns, name)


def signal_quantile_returns(returns: DataFrame, signal: DataFrame, n: int = N_QUANTILES, key: str = "id") -> DataFrame:
    """AGG20 by a signal ``(id, date, signal)``: securities bucketed by the
    day's signal (``ntile`` per date, ties by id) and the mean next-day return
    per bucket.  Days without a signal or a next return don't count; of several
    signals of one (id, date) the greatest."""
    w = Window.partitionBy(key).orderBy("date")
    r = returns.withColumn("fwd", F.lead("ret").over(w)).where(F.col("fwd").isNotNull()).select(key, "date", "fwd")
    s = signal.where(F.col("signal").isNotNull()).groupBy(key, "date").agg(F.max("signal").alias("signal"))
    b = distributed_ntile(r.join(s, [key, "date"]), n, "date", "signal", key)
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd_return"))


def event_backtest(
    trades: DataFrame,
    securities: DataFrame,
    prices: DataFrame,
    bench_weights: DataFrame,
    calendar: DataFrame,
    *,
    run_name: str,
    start,
    end,
    implementation_lag: int = 1,
    rebalance_freq: str = "D",
    use_trading_dts: bool = False,
    scheme=pf.EQUAL,
    signal_fn: Callable[[DataFrame], DataFrame] | None = None,
    portfolio_fn: pf.PortfolioFn | None = None,
    actions: DataFrame | None = None,
) -> DataFrame:
    """DOM13: trades -> FIGI check -> long/short weights -> rebalance -> lag ->
    daily strategy and benchmark returns -> cumulative returns.
    ``use_trading_dts`` rebalances on the event dates only (instead of
    ``rebalance_freq``), holding the weights in between.  Trades of a
    security without a price series are skipped, as in the reference, where
    such a security is not a column of the price frame.

    ``signal_fn`` (U1) gets the filled prices ``(id, date, px)`` and returns
    ``(security, date, signal[, published])``, which ``checked_signal`` checks
    within the plan; the signal sizes the positions of ``scheme``.
    ``portfolio_fn`` (U3) turns each security's target weights into the weights
    held, day by day (``portfolio.user_portfolio``).
    With ``actions`` (dividends and splits, ``total_return_prices``) strategy
    and benchmark earn total returns; signals still see the prices as they
    were."""
    priced = prices.select(F.col("id").alias("security")).distinct()
    t = pf.map_to_figi(trades, securities).join(priced, "security", "left_semi")
    px = forward_fill(prices, calendar, end, "px")
    signal = None if signal_fn is None else pf.checked_signal(signal_fn(px), calendar)
    w = pf.build_port_weights(t, calendar, end, scheme, signal)
    w = pf.rebalance_hold(w, calendar, rebalance_freq, rebalance_dates=trades.select("date") if use_trading_dts else None)
    if portfolio_fn is not None:
        w = pf.user_portfolio(w, calendar, end, portfolio_fn)
    rets = daily_returns(px if actions is None else forward_fill(total_return_prices(prices, actions), calendar, end, "px"))
    daily = portfolio_returns(w, bench_weights.withColumnRenamed("id", "security").withColumnRenamed("w", "weight"),
                              rets, calendar, lag=implementation_lag, start=start, end=end)
    daily = daily.withColumn("run_name", F.lit(run_name))
    return cumulative_returns(daily).select("run_name", "date", "strategy_return", "benchmark_return",
                                            "strategy_cum", "benchmark_cum")
