"""Query keys for the headline operators (FLT1-3, WIN1-2, SRT1, DOM16, JN6, SRT6, DOM18, JN5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.operators import news
from pitwise.plans import fixtures as fx
from pitwise.plans.catalog import query

START = "2024-01-05"

_FILTER_SQL = """
SELECT * FROM v_headlines
WHERE wire IN ('BN', 'BFW') AND language = 'ENGLISH' AND length(headline) > 25
  AND arrival >= TIMESTAMP '2024-01-05' AND figi IN (SELECT figi FROM v_universe)"""

_DEDUP1_SQL = f"""
SELECT suid, headline, arrival, figi, wire, language FROM (
  SELECT *, row_number() OVER (PARTITION BY suid ORDER BY arrival, headline, figi, wire, language) AS rn
  FROM ({_FILTER_SQL})) WHERE rn = 1"""

_DEDUP2_SQL = f"""
SELECT suid, headline, arrival, figi, wire, language FROM (
  SELECT *, row_number() OVER (PARTITION BY CAST(arrival AS DATE), headline ORDER BY arrival, suid, figi, wire, language) AS rn
  FROM ({_DEDUP1_SQL})) WHERE rn = 1"""


def _filtered(spark, d):
    return news.filter_headlines(fx.v_headlines(spark, d), fx.v_universe(spark, d), START)


@query("headline_filter", _FILTER_SQL)
def headline_filter(spark, d):
    return _filtered(spark, d)


@query("headline_dedup_id", _DEDUP1_SQL)
def headline_dedup_id(spark, d):
    return news.dedupe_by_story(_filtered(spark, d))


@query("headline_dedup_day", _DEDUP2_SQL)
def headline_dedup_day(spark, d):
    return news.dedupe_by_day_headline(news.dedupe_by_story(_filtered(spark, d)))


@query("headline_clean", f"SELECT suid, lower(headline) AS headline, arrival, figi FROM ({_DEDUP2_SQL}) ORDER BY arrival, suid")
def headline_clean(spark, d):
    return news.build_news_dataset(fx.v_headlines(spark, d), fx.v_universe(spark, d), START)


@query("universe_semi", """
SELECT h.suid, h.figi FROM v_headlines h WHERE h.figi IN (SELECT figi FROM v_universe)""")
def universe_semi(spark, d):
    """JN5: keep headlines whose security is in the universe."""
    from pitwise.operators.calendar import keep_universe

    h = fx.v_headlines(spark, d).select("suid", "figi")
    return keep_universe(h, fx.v_universe(spark, d), "figi")


# Requests for the trailing window: every directional or hold decision (one per
# trade row), keyed by the security's FIGI and the decision date.
_REQ_SQL = """
SELECT DISTINCT 'F' || regexp_extract(security, '^T(\\d+) ', 1) AS figi, date AS as_of FROM v_trades"""


def _requests(spark, d):
    t = fx.v_trades(spark, d)
    return t.select(F.concat(F.lit("F"), F.regexp_extract("security", r"^T(\d+) ", 1)).alias("figi"),
                    F.col("date").alias("as_of")).distinct()


def _clean_news(spark, d):
    return news.build_news_dataset(fx.v_headlines(spark, d), fx.v_universe(spark, d), START, sort=False)


_CLEAN_SQL = f"SELECT suid, lower(headline) AS headline, arrival, figi FROM ({_DEDUP2_SQL})"

_WINDOW_SQL = f"""
SELECT r.figi, r.as_of, n.suid, n.headline, n.arrival
FROM ({_REQ_SQL}) r JOIN ({_CLEAN_SQL}) n
  ON n.figi = r.figi AND n.arrival >= CAST(r.as_of - INTERVAL 3 MONTH AS TIMESTAMP) AND n.arrival < CAST(r.as_of AS TIMESTAMP)"""


@query("news_window", _WINDOW_SQL)
def news_window(spark, d):
    return news.news_window(_requests(spark, d), _clean_news(spark, d))


_SAMPLE_SQL = f"""
SELECT figi, as_of, suid, headline, arrival FROM (
  SELECT *, row_number() OVER (PARTITION BY figi, as_of ORDER BY md5(suid || '|' || '0'), suid) AS rn
  FROM ({_WINDOW_SQL})) WHERE rn <= 50"""


@query("news_sample", _SAMPLE_SQL)
def news_sample(spark, d):
    return news.sample_news_window(_requests(spark, d), _clean_news(spark, d))


_UNDATED_SQL = f"""
SELECT r.figi, CAST(NULL AS DATE) AS as_of, n.suid, n.headline, n.arrival
FROM (SELECT DISTINCT figi FROM ({_REQ_SQL})) r JOIN ({_CLEAN_SQL}) n ON n.figi = r.figi"""


def _requests_some_undated(spark, d):
    """Every request, and one without a date for each security."""
    r = _requests(spark, d)
    return r.unionByName(r.select("figi", F.lit(None).cast("date").alias("as_of")).distinct())


@query("news_sample_undated", f"""
SELECT figi, as_of, suid, headline, arrival FROM (
  SELECT *, row_number() OVER (PARTITION BY figi, as_of ORDER BY md5(suid || '|' || '0'), suid) AS rn
  FROM ({_WINDOW_SQL} UNION ALL {_UNDATED_SQL})) WHERE rn <= 50""")
def news_sample_undated(spark, d):
    """FLT11: requests without a date take from all headlines of their security."""
    return news.sample_news_window(_requests_some_undated(spark, d), _clean_news(spark, d))


@query("news_window_undated", f"{_UNDATED_SQL}")
def news_window_undated(spark, d):
    return news.news_window(_requests_some_undated(spark, d).where("as_of is null"), _clean_news(spark, d))


@query("company_context", f"""
SELECT r.figi, r.as_of, s.id, s.name, s.sector, coalesce(h.n, 0) AS n_headlines, h.newest
FROM ({_REQ_SQL}) r
JOIN v_securities s ON s.figi = r.figi
LEFT JOIN (SELECT figi, as_of, count(*) AS n, arg_max(headline, (arrival, suid)) AS newest FROM ({_SAMPLE_SQL}) GROUP BY 1, 2) h
  ON h.figi = r.figi AND h.as_of = r.as_of""")
def company_context(spark, d):
    snap = _requests(spark, d).join(fx.v_securities(spark, d).select("figi", "id", "name", "sector"), "figi")
    sampled = news.sample_news_window(_requests(spark, d), _clean_news(spark, d))
    ctx = news.company_context(snap, sampled)
    return ctx.select("figi", "as_of", "id", "name", "sector", "n_headlines", F.element_at("headlines", 1).alias("newest"))
