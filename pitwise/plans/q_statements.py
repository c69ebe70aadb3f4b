"""Query keys for the point-in-time statement operators
(JN8, AGG10-12, WIN4, WIN6, FLT6-9, FLT13, AGG14-15, JN17, SRC2, DOM17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.operators import calendar as cal
from pitwise.operators import scoring as sc
from pitwise.operators import statements as st
from pitwise.plans import fixtures as fx
from pitwise.plans.catalog import query
from pitwise.plans.oracle_views import VIEWS
from pitwise.plans.q_calendar import calendar

_T = "t, t_1, t_2, t_3, t_4, t_5"


def pit_long(spark, d):
    return st.pit_asof(calendar(spark, d).select("as_of", "id"), fx.v_vintages(spark, d))


def matrix(spark, d):
    return st.statement_matrix(pit_long(spark, d))


@query("pit_asof", "SELECT as_of, id, statement, item_no, item, period_end, publish_date, value FROM v_pit")
def pit_asof(spark, d):
    return pit_long(spark, d)


@query("statement_matrix", f"SELECT as_of, id, statement, item_no, item, {_T} FROM v_matrix")
def statement_matrix(spark, d):
    return matrix(spark, d)


@query("matrix_periods", "SELECT as_of, count(*) AS n_periods FROM v_ranked GROUP BY as_of")
def matrix_periods(spark, d):
    return st.periods_per_date(pit_long(spark, d))


@query("statement_nonzero", f"""
SELECT as_of, id, statement, item_no, item, {_T} FROM v_matrix
WHERE t <> 0 OR t_1 <> 0 OR t_2 <> 0 OR t_3 <> 0 OR t_4 <> 0 OR t_5 <> 0""")
def statement_nonzero(spark, d):
    return st.drop_all_zero_items(matrix(spark, d))


@query("statement_any_positive", f"""
SELECT as_of, id, statement, item_no, item, {_T} FROM v_matrix
WHERE t > 0 OR t_1 > 0 OR t_2 > 0 OR t_3 > 0 OR t_4 > 0 OR t_5 > 0""")
def statement_any_positive(spark, d):
    return st.keep_any_positive(matrix(spark, d))


@query("statement_dedup_values", f"""
SELECT as_of, id, statement, item_no, item, {_T} FROM (
  SELECT *, row_number() OVER (PARTITION BY as_of, id, statement, {_T} ORDER BY item_no, item) AS rn FROM v_matrix)
WHERE rn = 1""")
def statement_dedup_values(spark, d):
    return st.dedupe_item_values(matrix(spark, d))


_LONG_SQL = f"""
SELECT as_of, id, statement, item_no, item, period_label, value
FROM v_matrix UNPIVOT (value FOR period_label IN ({_T}))"""


@query("statement_long", _LONG_SQL)
def statement_long(spark, d):
    return st.statement_long(matrix(spark, d))


@query("pit_nest")
def pit_nest(spark, d):
    """AGG12 (rows-only check: JSON text formatting is engine specific; the
    round trip ``pit_explode`` is checked value by value)."""
    return st.pit_nest(matrix(spark, d))


@query("pit_explode", f"SELECT as_of, id, statement, period_label, item, value FROM ({_LONG_SQL})")
def pit_explode(spark, d):
    return st.pit_explode(st.pit_nest(matrix(spark, d)))


@query("ltm_rolling", """
SELECT id, statement, item_no, period_end,
       CASE WHEN statement = 'is' THEN
              CASE WHEN count(value) OVER w = 4 AND date_diff('month', min(period_end) OVER w, period_end) = 9
                   THEN round(sum(value) OVER w, 6) END
            ELSE value END AS ltm_value
FROM v_facts
WINDOW w AS (PARTITION BY id, statement, item_no ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def ltm_rolling(spark, d):
    out = st.ltm(fx.v_facts(spark, d))
    return out.withColumn("ltm_value", F.round("ltm_value", 6))


@query("fx_convert", """
SELECT f.id, f.statement, f.item_no, f.period_end, f.value AS value_local, x.rate,
       round(CASE WHEN f.item_no IN (44) THEN f.value ELSE f.value * x.rate END, 6) AS value
FROM v_facts f ASOF LEFT JOIN (
  SELECT ccy_group, rate_date, arg_max(rate, version) AS rate FROM v_fx GROUP BY 1, 2) x ON x.ccy_group = f.k % 3 AND x.rate_date <= f.period_end""")
def fx_convert(spark, d):
    facts = fx.v_facts(spark, d)
    ccy = fx.v_securities(spark, d).select("id", (F.col("k") % 3).alias("ccy_group"))
    out = st.fx_convert(facts.drop("k"), fx.v_fx(spark, d), ccy, version=("version",))
    return out.withColumn("value", F.round("value", 6))


_LINE_SQL = "replace(substr(item, 4), ' (Adj)', '') || ': ' || " + " || ' | ' || ".join(f"printf('%.4f', {c})" for c in _T.split(", "))

VIEWS["v_record_lines"] = f"""
SELECT as_of, id, string_agg(line, chr(10) ORDER BY item_no, item) FILTER (WHERE statement = 'is') AS income,
       string_agg(line, chr(10) ORDER BY item_no, item) FILTER (WHERE statement = 'bs') AS balance
FROM (SELECT *, {_LINE_SQL} AS line FROM (
        SELECT *, row_number() OVER (PARTITION BY as_of, id, statement, {_T} ORDER BY item_no, item) AS rn FROM v_matrix)
      WHERE rn = 1 AND ({' OR '.join(f'{c} <> 0' for c in _T.split(', '))}))
GROUP BY as_of, id"""

VIEWS["v_record_prices"] = """
SELECT r.as_of, r.id, string_agg(strftime(p.date, '%Y-%m-%d') || ': ' || printf('%.4f', p.px), chr(10) ORDER BY p.date) AS prices
FROM (SELECT DISTINCT as_of, id FROM v_matrix) r JOIN v_stock_prices p
  ON p.id = r.id AND p.date >= CAST(r.as_of - INTERVAL 12 MONTH AS DATE) AND p.date <= r.as_of
GROUP BY r.as_of, r.id"""


@query("company_snapshot", """
SELECT m.as_of, m.id, s.figi, s.name, s.sector, m.n_items, m.eps_t,
       'Income Statement:' || chr(10) || coalesce(l.income, '') || chr(10) || 'Balance Sheet:' || chr(10) || coalesce(l.balance, '') AS sec_fs,
       'Historical Price:' || chr(10) || coalesce(p.prices, '') AS stock_price
FROM (SELECT as_of, id, count(*) AS n_items, max(CASE WHEN statement = 'is' AND item_no = 47 THEN t END) AS eps_t
      FROM v_matrix GROUP BY 1, 2) m JOIN v_securities s ON s.id = m.id
LEFT JOIN v_record_lines l ON l.as_of = m.as_of AND l.id = m.id
LEFT JOIN v_record_prices p ON p.as_of = m.as_of AND p.id = m.id""")
def company_snapshot(spark, d):
    """FLT13 in batch form: every (date, security) record with all its parts:
    statements, prices and metadata."""
    return sc.company_records(matrix(spark, d), fx.v_securities(spark, d), fx.v_stock_prices(spark, d))


@query("pit_dataset", """
WITH mem AS (
  SELECT DISTINCT c.as_of, c.id FROM v_cal c JOIN v_members m
    ON m.id = c.id AND m.start_date <= c.as_of AND (m.end_date IS NULL OR m.end_date > c.as_of)),
pit AS (SELECT p.* FROM v_pit p JOIN mem USING (as_of, id)),
rk AS (SELECT * FROM (
  SELECT as_of, period_end, dense_rank() OVER (PARTITION BY as_of ORDER BY period_end DESC) AS period_rank
  FROM (SELECT as_of, period_end FROM pit GROUP BY 1, 2 HAVING max(abs(value)) > 0)) WHERE period_rank <= 6)
SELECT p.as_of, p.id, s.figi, s.sector, count(DISTINCT (p.statement, p.item_no)) AS n_items,
       round(sum(CASE WHEN r.period_rank = 1 THEN p.value ELSE 0 END), 6) AS sum_t
FROM pit p JOIN rk r ON r.as_of = p.as_of AND r.period_end = p.period_end
JOIN v_securities s ON s.id = p.id
GROUP BY 1, 2, 3, 4""")
def pit_dataset(spark, d):
    """DOM17: members on each reporting date -> PIT as-of -> matrix -> metadata."""
    c = calendar(spark, d)
    m = fx.v_members(spark, d)
    mem = c.join(m, "id").where(
        (F.col("start_date") <= F.col("as_of")) & (F.col("end_date").isNull() | (F.col("end_date") > F.col("as_of")))
    ).select("as_of", "id").distinct()
    mat = st.statement_matrix(st.pit_asof(mem, fx.v_vintages(spark, d)))
    g = mat.groupBy("as_of", "id").agg(F.count("*").alias("n_items"), F.round(F.sum("t"), 6).alias("sum_t"))
    secs = fx.v_securities(spark, d).select("id", "figi", "sector")
    return st.attach_metadata(g, secs).select("as_of", "id", "figi", "sector", "n_items", "sum_t")
