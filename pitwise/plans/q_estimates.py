"""Query keys for EPS changes, the analyst baseline and estimate evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.operators import estimates as es
from pitwise.operators import statements as st
from pitwise.plans import fixtures as fx
from pitwise.plans.catalog import query
from pitwise.plans.oracle_views import classify_sql
from pitwise.plans.q_calendar import calendar
from pitwise.plans.q_statements import matrix

_CMP_COLS = ("security, date, current_reported_eps, analyst_estimated_eps, analyst_direction, analyst_magnitude, "
             "analyst_difference, current_eps, next_period, actual_direction, actual_magnitude, actual_difference")


def field(spark, d):
    return st.field_per_date(matrix(spark, d), fx.EPS_ITEM_NO)


def actual(spark, d):
    return es.eps_actual_change(field(spark, d))


def pairs(spark, d):
    return es.eps_pair(calendar(spark, d), fx.v_estimates(spark, d))


def ft_responses(spark, d):
    """The fixture's fine-tuned answers keyed like a results file: (security, date, response)."""
    t = fx.v_ft_text(spark, d)
    c = calendar(spark, d)
    return c.join(t, ["id", "period_end"]).select(F.col("id").alias("security"), F.col("as_of").alias("date"), "response")


def baseline(spark, d):
    return es.analyst_baseline(pairs(spark, d))


def compared(spark, d):
    return es.eps_compare(baseline(spark, d), actual(spark, d)).select(*[c.strip() for c in _CMP_COLS.split(",")])


@query("change_classify", f"""
SELECT a.id, a.period_end, a.value AS eps_t, e.value AS eps_t1, {classify_sql('a.value', 'e.value', 'change')}
FROM v_estimates a JOIN v_estimates e ON e.id = a.id AND e.period_end = a.period_end AND e.act_est = 'E'
WHERE a.act_est = 'A'""")
def change_classify(spark, d):
    est = fx.v_estimates(spark, d)
    a = est.where(F.col("act_est") == "A").select("id", "period_end", F.col("value").alias("eps_t"))
    e = est.where(F.col("act_est") == "E").select("id", "period_end", F.col("value").alias("eps_t1"))
    return es.classify(a.join(e, ["id", "period_end"]), "eps_t", "eps_t1", "change")


@query("field_per_date", "SELECT security, date, value FROM v_field")
def field_per_date(spark, d):
    return field(spark, d)


@query("eps_actual_change", """
SELECT security, date, current_eps, next_period, actual_direction, actual_magnitude, actual_difference FROM v_actual""")
def eps_actual_change(spark, d):
    return actual(spark, d)


@query("eps_pair", "SELECT security, date, current_reported_eps, analyst_estimated_eps FROM v_pairs")
def eps_pair(spark, d):
    return pairs(spark, d)


@query("analyst_baseline", """
SELECT security, date, current_reported_eps, analyst_estimated_eps, analyst_direction, analyst_magnitude,
       analyst_difference FROM v_baseline""")
def analyst_baseline(spark, d):
    return baseline(spark, d)


@query("eps_compare", f"SELECT {_CMP_COLS} FROM v_compare ORDER BY next_period")
def eps_compare(spark, d):
    return compared(spark, d).orderBy("next_period")


_SLE = ("CASE WHEN next_period - analyst_estimated_eps = 0 THEN CAST('inf' AS DOUBLE) "
        "ELSE pow(ln(abs(next_period - analyst_estimated_eps)), 2) END")


@query("eps_accuracy", """
SELECT count(*) AS n, round(avg(CASE WHEN analyst_direction = actual_direction THEN 1 ELSE 0 END), 6) AS accuracy
FROM v_compare""")
def eps_accuracy(spark, d):
    s = es.eps_scores(compared(spark, d))
    return s.select("n", F.round("accuracy", 6).alias("accuracy"))


@query("eps_rmsle", f"SELECT count(*) AS n, round(sqrt(avg({_SLE})), 6) AS rmsle FROM v_compare")
def eps_rmsle(spark, d):
    s = es.eps_scores(compared(spark, d))
    return s.select("n", F.round("rmsle", 6).alias("rmsle"))


@query("direction_confusion", """
SELECT analyst_direction,
       nullif(count(CASE WHEN actual_direction = 'DECREASING' THEN security END), 0) AS DECREASING,
       nullif(count(CASE WHEN actual_direction = 'INCREASING' THEN security END), 0) AS INCREASING
FROM v_compare GROUP BY analyst_direction""")
def direction_confusion(spark, d):
    return es.direction_confusion(compared(spark, d))


@query("eps_trendline", """
SELECT round(regr_slope(analyst_estimated_eps, next_period), 6) AS slope,
       round(regr_intercept(analyst_estimated_eps, next_period), 6) AS intercept,
       round(regr_r2(analyst_estimated_eps, next_period), 6) AS r2,
       CAST(regr_count(analyst_estimated_eps, next_period) AS BIGINT) AS n
FROM v_compare""")
def eps_trendline(spark, d):
    t = es.eps_trendline(compared(spark, d))
    return t.select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")], F.col("n").cast("long"))


@query("finetuned_eps", """
SELECT security, date, current_reported_eps, analyst_estimated_eps, analyst_direction, analyst_magnitude,
       analyst_difference FROM v_finetuned""")
def finetuned_eps(spark, d):
    return es.finetuned_estimates(ft_responses(spark, d), pairs(spark, d))


@query("strategy_leaderboard", f"""
WITH runs AS (
  SELECT 'analyst' AS run_name, security, date, analyst_estimated_eps, analyst_direction FROM v_baseline
  UNION ALL
  SELECT 'finetuned' AS run_name, security, date, analyst_estimated_eps, analyst_direction FROM v_finetuned),
cmp AS (SELECT r.*, a.next_period, a.actual_direction FROM runs r JOIN v_actual a ON a.security = r.security AND a.date = r.date)
SELECT run_name, count(*) AS n,
       round(avg(CASE WHEN analyst_direction = actual_direction THEN 1 ELSE 0 END), 6) AS accuracy,
       round(sqrt(avg({_SLE})), 6) AS rmsle
FROM cmp GROUP BY run_name""")
def strategy_leaderboard(spark, d):
    """SET5: several strategies in one frame keyed by run_name, scored in one grouped pass."""
    cols = ["security", "date", "analyst_estimated_eps", "analyst_direction"]
    runs = baseline(spark, d).select(F.lit("analyst").alias("run_name"), *cols).unionByName(
        es.finetuned_estimates(ft_responses(spark, d), pairs(spark, d))
        .select(F.lit("finetuned").alias("run_name"), *cols))
    cmp = es.eps_compare(runs, actual(spark, d).select("security", "date", "next_period", "actual_direction"))
    s = es.eps_scores(cmp, by=["run_name"])
    return s.select("run_name", "n", F.round("accuracy", 6).alias("accuracy"), F.round("rmsle", 6).alias("rmsle"))
