"""Query keys for positions, weights, returns and the event backtest
(JN2, JN7, AGG13, JN11, WIN7-12, JN13-14, AGG18-20, DOM12-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.operators import analytics as an
from pitwise.operators import portfolio as pf
from pitwise.plans import fixtures as fx
from pitwise.plans.catalog import query

# Backtest window of the fixture (the event stream covers January 2024).
START = "2024-01-01"
END = "2024-01-31"
RUN = "events"
ROLLING_N = 5


def _r(c: str, digits: int):
    # a cancelling sum can round to -0.0 or 0.0 depending on the order partial
    # sums are merged in; both engines map an exact zero to +0.0
    r = F.round(c, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(c)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_r(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes])


def positions(spark, d):
    return pf.position_state(fx.v_trades(spark, d), fx.v_calendar(spark, d), END)


def ls_weights(spark, d):
    pos = positions(spark, d)
    return pf.long_short(pf.leg_portfolio(pos, True), pf.leg_portfolio(pos, False))


def prices_filled(spark, d):
    return an.forward_fill(fx.v_prices(spark, d), fx.v_calendar(spark, d), END, "px")


def returns(spark, d):
    return an.daily_returns(prices_filled(spark, d))


def daily(spark, d):
    cal = fx.v_calendar(spark, d)
    bw = fx.v_weights_bm(spark, d).select(F.col("id").alias("security"), "date", F.col("w").alias("weight"))
    return an.portfolio_returns(ls_weights(spark, d), bw, returns(spark, d), cal, lag=1, start=START, end=END) \
        .withColumn("run_name", F.lit(RUN))


@query("figi_map", """
SELECT t.date, t.security, s.figi, t.decision, t.seq FROM v_trades t JOIN v_securities s ON s.id = t.security ORDER BY t.seq""")
def figi_map(spark, d):
    t = pf.map_to_figi(fx.v_trades(spark, d), fx.v_securities(spark, d))
    return t.select("date", "security", "figi", "decision", "seq").orderBy("seq")


@query("position_state", "SELECT date, security, state FROM v_pos")
def position_state(spark, d):
    return positions(spark, d)


@query("leg_equal", """
SELECT date, security, round(1.0 / (1.0 * count(*) OVER (PARTITION BY date)), 6) AS weight FROM v_pos WHERE state = 'LONG'""")
def leg_equal(spark, d):
    return round_doubles(pf.leg_portfolio(positions(spark, d), True, pf.EQUAL))


@query("leg_proportional", """
SELECT l.date, l.security, round(p.px / (1.0 * sum(p.px) OVER (PARTITION BY l.date)), 6) AS weight
FROM v_pos l LEFT JOIN v_prices p ON p.id = l.security AND p.date = l.date WHERE l.state = 'SHORT'""")
def leg_proportional(spark, d):
    sig = fx.v_prices(spark, d).select("date", F.col("id").alias("security"), F.col("px").alias("signal"))
    return round_doubles(pf.leg_portfolio(positions(spark, d), False, pf.PROPORTIONAL, sig).select(
        "date", "security", F.abs("weight").alias("weight")))


@query("long_short", "SELECT date, security, round(weight, 6) AS weight FROM v_ls")
def long_short(spark, d):
    return round_doubles(ls_weights(spark, d))


@query("weight_lag", "SELECT date, security, round(weight, 6) AS weight FROM v_ls_lagged")
def weight_lag(spark, d):
    return round_doubles(pf.lag_weights(ls_weights(spark, d), fx.v_calendar(spark, d), 1))


@query("rebalance_hold", """
WITH anchors AS (
  SELECT date, max(r) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS anchor FROM (
    SELECT c.date, l.r FROM v_calendar c LEFT JOIN (
      SELECT max(date) AS r FROM v_calendar GROUP BY date_trunc('week', date)) l ON l.r = c.date))
SELECT a.date, w.security, round(w.weight, 6) AS weight
FROM anchors a JOIN v_ls w ON w.date = a.anchor""")
def rebalance_hold(spark, d):
    return round_doubles(pf.rebalance_hold(ls_weights(spark, d), fx.v_calendar(spark, d), "W"))


@query("rebalance_events", """
WITH anchors AS (
  SELECT date, max(r) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS anchor FROM (
    SELECT c.date, e.r FROM v_calendar c LEFT JOIN (
      SELECT DISTINCT (SELECT min(t.date) FROM v_calendar t WHERE t.date >= d.date) AS r FROM v_event_days d) e ON e.r = c.date))
SELECT a.date, w.security, round(w.weight, 6) AS weight
FROM anchors a JOIN v_ls w ON w.date = a.anchor""")
def rebalance_events(spark, d):
    """WIN10 with the reference's ``use_trading_dts``: rebalance on event dates (each week's busiest day)."""
    return round_doubles(pf.rebalance_hold(ls_weights(spark, d), fx.v_calendar(spark, d), rebalance_dates=fx.v_event_days(spark, d)))


@query("price_ffill", "SELECT id, date, px FROM v_px")
def price_ffill(spark, d):
    return prices_filled(spark, d)


@query("beta_ffill", f"""
SELECT g.id, g.date,
       (SELECT arg_max(b.beta, b.date) FROM v_beta b WHERE b.id = g.id AND b.date <= g.date) AS beta
FROM (SELECT f.id, CAST(unnest(generate_series(f.start, DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT id, min(date) AS start FROM v_beta GROUP BY id) f) g
JOIN v_calendar c ON c.date = g.date""")
def beta_ffill(spark, d):
    b = fx.v_beta(spark, d).select("id", "date", "beta")
    return an.weekly_to_daily(b, fx.v_calendar(spark, d), END, "beta")


@query("total_return", """
SELECT id, date, round(px, 4) AS px, round(px / lag(px) OVER (PARTITION BY id ORDER BY date) - 1, 6) AS ret FROM v_total_px""")
def total_return(spark, d):
    px = an.total_return_prices(fx.v_prices(spark, d), fx.v_actions(spark, d))
    out = px.join(an.daily_returns(px), ["id", "date"], "left")
    return out.select("id", "date", F.round("px", 4).alias("px"), F.round("ret", 6).alias("ret"))


@query("daily_return", "SELECT id, date, round(ret, 6) AS ret FROM v_rets")
def daily_return(spark, d):
    return round_doubles(returns(spark, d))


@query("portfolio_return", """
SELECT date, round(strategy_return, 6) AS strategy_return, round(benchmark_return, 6) AS benchmark_return FROM v_daily""")
def portfolio_return(spark, d):
    return round_doubles(daily(spark, d).drop("run_name"))


_CUM = """CASE WHEN min({c}) OVER w <= -1 THEN -1.0 ELSE exp(sum(ln(1 + {c})) OVER w) - 1 END"""


@query("cumulative_return", f"""
SELECT 'events' AS run_name, date, round(strategy_return, 6) AS strategy_return, round(benchmark_return, 6) AS benchmark_return,
       round({_CUM.format(c='strategy_return')}, 6) AS strategy_cum, round({_CUM.format(c='benchmark_return')}, 6) AS benchmark_cum
FROM v_daily WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def cumulative_return(spark, d):
    return round_doubles(an.cumulative_returns(daily(spark, d)).select(
        "run_name", "date", "strategy_return", "benchmark_return", "strategy_cum", "benchmark_cum"))


@query("event_backtest", f"""
SELECT 'events' AS run_name, date, round(strategy_return, 6) AS strategy_return, round(benchmark_return, 6) AS benchmark_return,
       round({_CUM.format(c='strategy_return')}, 6) AS strategy_cum, round({_CUM.format(c='benchmark_return')}, 6) AS benchmark_cum
FROM v_daily WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def event_backtest(spark, d):
    """DOM13, the flagship: the full backtest from trade events."""
    out = an.event_backtest(
        fx.v_trades(spark, d), fx.v_securities(spark, d), fx.v_prices(spark, d), fx.v_weights_bm(spark, d),
        fx.v_calendar(spark, d), run_name=RUN, start=START, end=END, implementation_lag=1, rebalance_freq="D")
    return round_doubles(out)


@query("yearly_performance", """
WITH d AS (
  SELECT *, year(date) AS year,
         exp(sum(ln(1 + strategy_return)) OVER (PARTITION BY year(date) ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth
  FROM v_daily),
dd AS (SELECT *, wealth / greatest(max(wealth) OVER (PARTITION BY year ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS ddn
       FROM d)
SELECT 'events' AS run_name, year, count(strategy_return) AS n_days,
       round(CASE WHEN min(strategy_return) <= -1 THEN -1.0 ELSE exp(sum(ln(1 + strategy_return))) - 1 END, 6) AS total_return,
       round(CASE WHEN count(strategy_return) >= 2 AND stddev_samp(strategy_return) > 0
                  THEN stddev_samp(strategy_return) * sqrt(252) END, 6) AS volatility,
       round(CASE WHEN count(strategy_return) >= 2 AND stddev_samp(strategy_return) > 0
                  THEN avg(strategy_return) / stddev_samp(strategy_return) * sqrt(252) END, 6) AS sharpe,
       round(min(ddn), 6) AS max_drawdown,
       round(avg(CASE WHEN strategy_return > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
FROM dd GROUP BY year""")
def yearly_performance(spark, d):
    return round_doubles(an.yearly_performance(daily(spark, d), "strategy_return"))


@query("rolling_sharpe", f"""
SELECT 'events' AS run_name, date,
       round(CASE WHEN count(strategy_return) OVER w = {ROLLING_N} AND stddev_samp(strategy_return) OVER w > 0
                  THEN avg(strategy_return) OVER w / stddev_samp(strategy_return) OVER w * sqrt(252) END, 6) AS rolling_sharpe
FROM v_daily WINDOW w AS (ORDER BY date ROWS BETWEEN {ROLLING_N - 1} PRECEDING AND CURRENT ROW)""")
def rolling_sharpe(spark, d):
    return round_doubles(an.rolling_sharpe(daily(spark, d), "strategy_return", ROLLING_N))


@query("descriptive_stats", """
WITH m AS (SELECT avg(strategy_return) AS mu FROM v_daily),
c AS (SELECT strategy_return - mu AS x, strategy_return AS r FROM v_daily, m)
SELECT 'events' AS run_name, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS stddev,
       round(avg(x * x * x) / pow(avg(x * x), 1.5), 6) AS skewness,
       round(avg(x * x * x * x) / (avg(x * x) * avg(x * x)) - 3, 6) AS kurtosis,
       round(min(r), 6) AS min, round(max(r), 6) AS max
FROM c""")
def descriptive_stats(spark, d):
    return round_doubles(an.descriptive_stats(daily(spark, d), "strategy_return"))


@query("quantile_returns", """
WITH f AS (SELECT id, date, ret, lead(ret) OVER (PARTITION BY id ORDER BY date) AS fwd FROM v_rets),
b AS (SELECT *, ntile(5) OVER (PARTITION BY date ORDER BY ret, id) AS bucket FROM f WHERE fwd IS NOT NULL)
SELECT bucket, count(*) AS n, round(avg(fwd), 6) AS mean_fwd_return FROM b GROUP BY bucket""")
def quantile_returns(spark, d):
    return round_doubles(an.quantile_returns(returns(spark, d)))


@query("sector_exposure", """
SELECT w.date, l.level, l.industry,
       CASE WHEN round(sum(w.weight), 6) = 0 THEN 0.0 ELSE round(sum(w.weight), 6) END AS net_weight,
       round(sum(abs(w.weight)), 6) AS gross_weight
FROM v_ls w JOIN v_securities s ON s.id = w.security,
     LATERAL (SELECT 1 AS level, s.sector AS industry UNION ALL
              SELECT 2 AS level, s.sector || '/' || CAST(s.nation AS VARCHAR) AS industry) l
GROUP BY 1, 2, 3""")
def sector_exposure(spark, d):
    return round_doubles(an.sector_exposure(ls_weights(spark, d), fx.v_securities(spark, d)))


@query("industry_exposure", """
WITH i AS (SELECT security, valid_from, unnest([1, 2, 3, 4]) AS level,
                  unnest([arg_max(level_1, version), arg_max(level_2, version), arg_max(level_3, version), arg_max(level_4, version)]) AS industry
           FROM (SELECT * REPLACE (coalesce(level_1, 'unclassified') AS level_1, coalesce(level_2, 'unclassified') AS level_2,
                                   coalesce(level_3, 'unclassified') AS level_3, coalesce(level_4, 'unclassified') AS level_4) FROM v_industries)
           GROUP BY 1, 2),
w AS (SELECT date, security, weight, unnest([1, 2, 3, 4]) AS level FROM v_ls),
j AS (SELECT w.date, w.level, w.weight, coalesce(i.industry, 'unclassified') AS industry
      FROM w ASOF LEFT JOIN i ON w.security = i.security AND w.level = i.level AND i.valid_from <= w.date)
SELECT date, level, industry, CASE WHEN round(sum(weight), 6) = 0 THEN 0.0 ELSE round(sum(weight), 6) END AS net_weight,
       round(sum(abs(weight)), 6) AS gross_weight
FROM j GROUP BY 1, 2, 3""")
def industry_exposure(spark, d):
    """JN14: four dated levels."""
    return round_doubles(an.industry_exposure(ls_weights(spark, d), fx.v_industries(spark, d), version=("version",)))


@query("benchmark_statistics", """
WITH d AS (SELECT year(date) AS year, strategy_return AS s, benchmark_return AS b, strategy_return - benchmark_return AS e FROM v_daily)
SELECT 'events' AS run_name, year, count(e) AS n_days, round(exp(sum(ln(1 + b))) - 1, 6) AS benchmark_return,
       round(stddev_samp(b) * sqrt(252), 6) AS benchmark_volatility, round(avg(b) / stddev_samp(b) * sqrt(252), 6) AS benchmark_sharpe,
       round(exp(sum(ln(1 + s))) - exp(sum(ln(1 + b))), 6) AS excess_return, round(covar_samp(s, b) / var_samp(b), 6) AS beta,
       round(stddev_samp(e) * sqrt(252), 6) AS tracking_error, round(avg(e) / stddev_samp(e) * sqrt(252), 6) AS information_ratio
FROM d GROUP BY year""")
def benchmark_statistics(spark, d):
    """AGG19, benchmark columns."""
    return round_doubles(an.benchmark_statistics(daily(spark, d)))


@query("rolling_benchmark", f"""
WITH d AS (SELECT date, strategy_return AS s, benchmark_return AS b, strategy_return - benchmark_return AS e FROM v_daily)
SELECT 'events' AS run_name, date,
       CASE WHEN count(e) OVER w = {ROLLING_N} AND stddev_samp(b) OVER w > 0 THEN round(avg(b) OVER w / stddev_samp(b) OVER w * sqrt(252), 5) END AS benchmark_sharpe,
       CASE WHEN count(e) OVER w = {ROLLING_N} AND var_samp(b) OVER w > 0 THEN round(covar_samp(s, b) OVER w / var_samp(b) OVER w, 5) END AS beta,
       CASE WHEN count(e) OVER w = {ROLLING_N} AND stddev_samp(e) OVER w > 0 THEN round(stddev_samp(e) OVER w * sqrt(252), 5) END AS tracking_error,
       CASE WHEN count(e) OVER w = {ROLLING_N} AND stddev_samp(e) OVER w > 0 THEN round(avg(e) OVER w / stddev_samp(e) OVER w * sqrt(252), 5) END AS information_ratio
FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN {ROLLING_N - 1} PRECEDING AND CURRENT ROW)""")
def rolling_benchmark(spark, d):
    """WIN11, benchmark series."""
    return round_doubles(an.rolling_benchmark(daily(spark, d), ROLLING_N), 5)


def _px_signal(px):
    """The price itself, published on its own day."""
    return px.select(F.col("id").alias("security"), "date", F.col("px").alias("signal"), F.col("date").alias("published"))


@query("signal_quantile_returns", """
WITH f AS (SELECT id, date, lead(ret) OVER (PARTITION BY id ORDER BY date) AS fwd FROM v_rets),
b AS (SELECT f.*, ntile(5) OVER (PARTITION BY f.date ORDER BY floor(p.px), f.id) AS bucket
      FROM f JOIN v_px p ON p.id = f.id AND p.date = f.date WHERE fwd IS NOT NULL)
SELECT bucket::INTEGER AS bucket, count(*) AS n, round(avg(fwd), 6) AS mean_fwd_return FROM b GROUP BY bucket""")
def signal_quantile_returns(spark, d):
    """AGG20 by a signal with ties: whole prices."""
    px = prices_filled(spark, d)
    signal = px.select("id", "date", F.floor("px").cast("double").alias("signal"))
    return round_doubles(an.signal_quantile_returns(an.daily_returns(px), signal))


@query("event_backtest_signal", f"""
WITH pos AS (SELECT p.date, p.security, p.state, x.px FROM v_pos p LEFT JOIN v_px x ON x.id = p.security AND x.date = p.date),
ls AS (SELECT date, security, px / (CASE state WHEN 'LONG' THEN 1.0 ELSE -1.0 END * sum(px) OVER (PARTITION BY date, state)) AS weight FROM pos),
lagged AS (SELECT c2.date, w.security, w.weight FROM ls w JOIN v_calendar c1 ON c1.date = w.date JOIN v_calendar c2 ON c2.idx = c1.idx + 1),
s AS (SELECT l.date, sum(l.weight * coalesce(r.ret, 0.0)) AS r FROM lagged l LEFT JOIN v_rets r ON r.id = l.security AND r.date = l.date GROUP BY 1),
d AS (SELECT v.date, coalesce(s.r, 0.0) AS strategy_return, v.benchmark_return FROM v_daily v LEFT JOIN s USING (date))
SELECT 'events' AS run_name, date, round(strategy_return, 6) AS strategy_return, round(benchmark_return, 6) AS benchmark_return,
       round({_CUM.format(c='strategy_return')}, 6) AS strategy_cum, round({_CUM.format(c='benchmark_return')}, 6) AS benchmark_cum
FROM d WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def event_backtest_signal(spark, d):
    """DOM13 with a user's signal (U1), which sizes the positions."""
    out = an.event_backtest(
        fx.v_trades(spark, d), fx.v_securities(spark, d), fx.v_prices(spark, d), fx.v_weights_bm(spark, d),
        fx.v_calendar(spark, d), run_name=RUN, start=START, end=END, scheme=pf.PROPORTIONAL, signal_fn=_px_signal)
    return round_doubles(out)


_LIMIT = 0.005


@query("user_portfolio", f"""
SELECT * FROM (WITH RECURSIVE t AS (SELECT w.security, w.date, c.idx, w.weight AS target, row_number() OVER (PARTITION BY w.security ORDER BY c.idx) AS i
                     FROM v_ls w JOIN v_calendar c ON c.date = w.date),
h AS (SELECT security, date, i, 0.0::DOUBLE + greatest(-{_LIMIT}, least({_LIMIT}, target)) AS weight FROM t WHERE i = 1
      UNION ALL
      SELECT t.security, t.date, t.i, h.weight + greatest(-{_LIMIT}, least({_LIMIT}, t.target - h.weight))
      FROM h JOIN t ON t.security = h.security AND t.i = h.i + 1)
SELECT date, security, CASE WHEN round(weight, 6) = 0 THEN 0.0 ELSE round(weight, 6) END AS weight FROM h)""")
def user_portfolio(spark, d):
    """U3: weights that move by at most 0.005 a day."""
    return round_doubles(pf.user_portfolio(ls_weights(spark, d), fx.v_calendar(spark, d), END, pf.turnover_limit(_LIMIT)))
