"""Query keys for the calendar and universe operators (AGG1-5, WIN5, JN3-5, JN9-10, JN16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.operators import calendar as cal
from pitwise.operators import statements as st
from pitwise.plans import fixtures as fx
from pitwise.plans.catalog import query

START = "1996-01-01"


def calendar(spark, d):
    return cal.reporting_dates(fx.v_reports(spark, d), START)


@query("reporting_dates", "SELECT as_of, id, period_end FROM v_cal ORDER BY as_of, id")
def reporting_dates(spark, d):
    return calendar(spark, d).orderBy("as_of", "id")


@query("reporting_dates_skip_first", """
SELECT as_of, id, period_end FROM v_cal WHERE as_of > (SELECT min(as_of) FROM v_cal) ORDER BY as_of, id""")
def reporting_dates_skip_first(spark, d):
    """K1 as the reference runs it: the earliest reporting date is skipped."""
    return cal.reporting_dates(fx.v_reports(spark, d), START, skip_first=True).orderBy("as_of", "id")


@query("unique_securities", "SELECT DISTINCT id FROM v_cal")
def unique_securities(spark, d):
    return cal.unique_securities(calendar(spark, d))


@query("reporting_calendar", "SELECT DISTINCT as_of FROM v_cal ORDER BY as_of")
def reporting_calendar(spark, d):
    return cal.reporting_calendar(calendar(spark, d))


@query("total_securities", "SELECT count(*) AS n_records FROM (SELECT DISTINCT as_of, id FROM v_cal)")
def total_securities(spark, d):
    return cal.total_securities(calendar(spark, d))


@query("securities_by_date", """
SELECT as_of, array_to_string(list_sort(list(id)), ',') AS ids, count(*) AS n
FROM (SELECT DISTINCT as_of, id FROM v_cal) GROUP BY as_of""")
def securities_by_date(spark, d):
    return cal.securities_by_date(calendar(spark, d)).select("as_of", F.array_join("ids", ",").alias("ids"), "n")


@query("ticker_root_dedup", """
SELECT as_of, id, period_end, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY as_of, split_part(id, ' ', 1) ORDER BY seq, id, period_end) AS rn
  FROM v_reports) WHERE rn = 1""")
def ticker_root_dedup(spark, d):
    return cal.ticker_root_dedup(fx.v_reports(spark, d))


@query("date_security_pairs", "SELECT DISTINCT as_of AS date, id AS security FROM v_cal")
def date_security_pairs(spark, d):
    return cal.date_security_pairs(calendar(spark, d))


@query("index_members", """
SELECT m.index_id, r.rebalance_date, m.id
FROM v_members m JOIN v_rebalance_dates r
  ON m.start_date <= r.rebalance_date AND (m.end_date IS NULL OR m.end_date > r.rebalance_date)""")
def index_members(spark, d):
    return cal.index_members(fx.v_members(spark, d), fx.v_rebalance_dates(spark, d))


@query("universe_anti", "SELECT DISTINCT figi FROM v_universe WHERE figi NOT IN (SELECT figi FROM v_universe_b)")
def universe_anti(spark, d):
    return cal.universe_minus(fx.v_universe(spark, d), fx.v_universe_b(spark, d), "figi")


@query("metadata_join", """
SELECT c.as_of, c.id, s.figi, s.name, s.sector FROM v_cal c LEFT JOIN v_securities s ON s.id = c.id""")
def metadata_join(spark, d):
    secs = fx.v_securities(spark, d).select("id", "figi", "name", "sector")
    return st.attach_metadata(calendar(spark, d), secs).select("as_of", "id", "figi", "name", "sector")


@query("revision_date", """
SELECT c.as_of, c.id, c.period_end, r.revision_date
FROM v_cal c LEFT JOIN (SELECT id, arg_max(revision_date, (period_end, revision_date)) AS revision_date
                        FROM v_vintages GROUP BY id) r ON r.id = c.id""")
def revision_date(spark, d):
    return st.attach_revision_date(calendar(spark, d), fx.v_vintages(spark, d)).select(
        "as_of", "id", "period_end", "revision_date")
