"""EPS change, analyst baseline and estimate evaluation
(DOM1-4, DOM9, DOM11, AGG6-9, AGG21, WIN3, JN1, SET5)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.classify import DECREASING, INCREASING, interpret_change

DIRECTIONS = (DECREASING, INCREASING)


def classify(df: DataFrame, prior: str, nxt: str, prefix: str, signed: bool = False) -> DataFrame:
    """DOM1 applied to two columns: adds ``{prefix}_direction``,
    ``{prefix}_magnitude`` (band) and ``{prefix}_difference``."""
    c = interpret_change(F.col(prior), F.col(nxt), signed)
    return df.withColumn("__c", c).select(
        *df.columns,
        F.col("__c.direction").alias(f"{prefix}_direction"),
        F.col("__c.band").alias(f"{prefix}_magnitude"),
        F.col("__c.magnitude").alias(f"{prefix}_difference"),
    )


def eps_actual_change(field: DataFrame, signed: bool = False) -> DataFrame:
    """WIN3 + DOM3: next reported value of the same security (K18: the next
    report date, not the next quarter); the last report has no row."""
    w = Window.partitionBy("security").orderBy("date")
    nxt = field.select("security", "date", F.col("value").alias("current_eps"),
                       F.lead("value").over(w).alias("next_period")).where(F.col("next_period").isNotNull())
    return classify(nxt, "current_eps", "next_period", "actual", signed)


def eps_pair(calendar: DataFrame, estimates: DataFrame) -> DataFrame:
    """AGG21: (current actual, next-period estimate) per (security, date) as
    known on the date: of the actuals (and of the estimates) with
    ``publish_date <= as_of``, the one of the latest period, in its latest
    version.  Requests for which nothing was published yet give no row.

    One window per security over its publications and request dates, in date
    order with publications first; a running maximum carries the answer, so
    nothing published later can enter.  A partition holds one security's
    history."""
    known = F.struct("period_end", "publish_date", "value")
    ev = estimates.select(
        "id", F.col("publish_date").alias("__d"), F.lit(0).alias("__kind"),
        F.when((F.col("act_est") == "A") & (F.col("offset") == 0), known).alias("__a"),
        F.when((F.col("act_est") == "E") & (F.col("offset") == 1), known).alias("__e"))
    rq = calendar.select("id", F.col("as_of").alias("__d")).distinct().withColumn("__kind", F.lit(1))
    w = Window.partitionBy("id").orderBy("__d", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    u = ev.unionByName(rq, allowMissingColumns=True).select(
        "id", "__d", "__kind", F.max("__a").over(w).alias("__a"), F.max("__e").over(w).alias("__e"))
    return u.where((F.col("__kind") == 1) & (F.col("__a").isNotNull() | F.col("__e").isNotNull())).select(
        F.col("id").alias("security"), F.col("__d").alias("date"), F.col("__a.value").alias("current_reported_eps"),
        F.col("__e.value").alias("analyst_estimated_eps"))


def analyst_baseline(pairs: DataFrame, signed: bool = False) -> DataFrame:
    """DOM4: the analyst estimate classified against the current actual."""
    p = pairs.where(F.col("current_reported_eps").isNotNull() & F.col("analyst_estimated_eps").isNotNull())
    return classify(p, "current_reported_eps", "analyst_estimated_eps", "analyst", signed)


def eps_compare(estimates: DataFrame, actual: DataFrame) -> DataFrame:
    """JN1: estimates joined to actual changes on (security, date), rows with
    any null dropped."""
    return estimates.join(actual, ["security", "date"]).na.drop("any")


def _hit():
    return (F.col("analyst_direction") == F.col("actual_direction")).cast("int")


def _sle():
    d = F.col("next_period") - F.col("analyst_estimated_eps")
    # K3: the reference squares ln|d|; ln(0) is -inf there (squared: +inf),
    # while Spark's ln(0) is NULL and would be skipped by avg.
    return F.when(d == 0, F.lit(math.inf)).otherwise(F.pow(F.ln(F.abs(d)), 2))


def eps_scores(compared: DataFrame, by=()) -> DataFrame:
    """AGG6 + AGG7 (DOM11): direction accuracy and the reference's log-error score."""
    return compared.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(_hit()).alias("accuracy"),
        F.sqrt(F.avg(_sle())).alias("rmsle"),
    )


def direction_confusion(compared: DataFrame) -> DataFrame:
    """AGG8: count of securities by predicted x actual direction; absent cells NULL."""
    aggs = []
    for d in DIRECTIONS:
        n = F.count(F.when(F.col("actual_direction") == d, F.col("security")))
        aggs.append(F.when(n > 0, n).alias(d))
    return compared.groupBy("analyst_direction").agg(*aggs)


def eps_trendline(compared: DataFrame, y: str = "analyst_estimated_eps", x: str = "next_period") -> DataFrame:
    """AGG9: OLS line of the estimate on the actual."""
    return compared.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"),
    )


def finetuned_estimates(responses: DataFrame, pairs: DataFrame, signed: bool = False) -> DataFrame:
    """DOM9: a fine-tuned model's answers ``(security, date, response)``: the
    number in the first four characters (SC15, ``try_cast``; non-numbers are
    dropped, K15) is the estimate, classified against the current actual of
    the same (security, date) from ``eps_pair``."""
    est = responses.select("security", "date",
                           F.expr("try_cast(substr(response, 1, 4) AS double)").alias("analyst_estimated_eps"))
    j = est.join(pairs.select("security", "date", "current_reported_eps"), ["security", "date"]).na.drop("any")
    return classify(j, "current_reported_eps", "analyst_estimated_eps", "analyst", signed).select(
        "security", "date", "current_reported_eps", "analyst_estimated_eps",
        "analyst_direction", "analyst_magnitude", "analyst_difference")
