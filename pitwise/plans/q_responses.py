"""Query keys for responses and trade reports (DOM5-8, DOM10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.operators import responses as rs
from pitwise.plans import fixtures as fx
from pitwise.plans.catalog import query


def parsed_sql(view: str) -> str:
    """DOM5 over a view with ``response_raw``, in DuckDB SQL."""
    closed = r"(?s)^.*?```json(.*?\})```(.*)$"
    return f"""
SELECT *, CASE WHEN json_text IS NOT NULL AND json_valid(json_text) AND json_type(json_text) = 'OBJECT'
               THEN json_text END AS pj
FROM (
  SELECT *,
         CASE WHEN regexp_matches(line, '{closed}') THEN regexp_extract(line, '{closed}', 1)
              WHEN contains(line, '```json') THEN regexp_extract(line, '(?s)```json(.*)$', 1) END AS json_text,
         CASE WHEN contains(line, '```json') THEN split_part(line, '```json', 1) ||
              CASE WHEN regexp_matches(line, '{closed}') THEN regexp_extract(line, '{closed}', 2) ELSE '' END END AS additional_context
  FROM (SELECT *, replace(response_raw, chr(10), '') AS line FROM {view}))"""


@query("response_json", f"""
SELECT run_name, date, security, event_id, json_text, additional_context, pj IS NOT NULL AS is_parsed,
       json_extract_string(pj, '$.decision') AS decision_key
FROM ({parsed_sql('v_responses')})""")
def response_json(spark, d):
    p = rs.parse_responses(fx.v_responses(spark, d))
    return p.select("run_name", "date", "security", "event_id", "json_text", "additional_context",
                    F.col("response").isNotNull().alias("is_parsed"), F.col("response")["decision"].alias("decision_key"))


_KEYWORD = """CASE WHEN (CASE WHEN instr(response_raw, 'BUY') > 0 THEN 1 ELSE 0 END
                 + CASE WHEN instr(response_raw, 'SELL') > 0 THEN 1 ELSE 0 END
                 + CASE WHEN instr(response_raw, 'HOLD') > 0 THEN 1 ELSE 0 END) = 1
            THEN CASE WHEN instr(response_raw, 'BUY') > 0 THEN 'BUY' WHEN instr(response_raw, 'SELL') > 0 THEN 'SELL'
                      ELSE 'HOLD' END
            ELSE 'Missing' END"""


@query("trade_report", f"""
SELECT run_name, date, security, event_id,
       CASE WHEN pj IS NOT NULL THEN coalesce(json_extract_string(pj, '$.decision'), 'Missing') ELSE {_KEYWORD} END AS decision,
       CASE WHEN pj IS NOT NULL THEN coalesce(json_extract_string(pj, '$."confidence score"'),
                                              json_extract_string(pj, '$.confidence')) END AS confidence
FROM ({parsed_sql('v_responses')})""")
def trade_report(spark, d):
    return rs.trade_report(rs.parse_responses(fx.v_responses(spark, d)))


def _quoted(key: str) -> str:
    pat = "['\"]" + key + "['\"]\\s*:\\s*['\"]([^'\"]*)['\"]"
    return "nullif(regexp_extract(response_raw, '" + pat.replace("'", "''") + "', 1), '')"


def _number(key: str) -> str:
    pat = "['\"]" + key + "['\"]\\s*:\\s*['\"]?([0-9]+)"
    return "nullif(regexp_extract(response_raw, '" + pat.replace("'", "''") + "', 1), '')"


def _dir(x: str) -> str:
    return f"CASE WHEN upper(trim({x})) IN ('INCREASE', 'INCREASING') THEN 'INCREASING' ELSE 'DECREASING' END"


@query("earnings_report", f"""
SELECT run_name, date, security, event_id,
       {_dir("coalesce(json_extract_string(pj, '$.earnings'), json_extract_string(pj, '$.analyst_direction'), " + _quoted('earnings') + ")")} AS analyst_direction,
       coalesce(json_extract_string(pj, '$.magnitude'), json_extract_string(pj, '$.analyst_magnitude'), {_quoted('magnitude')}) AS analyst_magnitude,
       coalesce(json_extract_string(pj, '$.confidence'), {_number('confidence')}) AS confidence
FROM ({parsed_sql('v_earnings_responses')})""")
def earnings_report(spark, d):
    return rs.earnings_report(rs.parse_responses(fx.v_earnings_responses(spark, d)))


@query("agent_normalise", f"""
SELECT date, security, decision, confidence, {_dir('earning_decision')} AS analyst_direction,
       earning_magnitude AS analyst_magnitude
FROM v_agent_results""")
def agent_normalise(spark, d):
    return rs.agent_normalise(fx.v_agent_results(spark, d))


@query("trade_projection", "SELECT date, security, decision, confidence FROM v_agent_results")
def trade_projection(spark, d):
    return rs.trade_projection(fx.v_agent_results(spark, d), trade_only=True)


@query("trade_projection_full", "SELECT date, security, decision, confidence, earning_decision, earning_magnitude FROM v_agent_results")
def trade_projection_full(spark, d):
    return rs.trade_projection(fx.v_agent_results(spark, d), trade_only=False)
