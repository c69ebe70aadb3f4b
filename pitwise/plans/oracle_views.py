"""The fixture bindings of ``plans/fixtures.py`` written in DuckDB SQL.

Each oracle query names the views it needs; ``with_views`` prepends the
matching common table expressions (and the ones those depend on).
"""

from __future__ import annotations

import re

R4 = "(floor(({x}) * 10000.0 + 0.5) / 10000.0)"


def r4(x: str) -> str:
    return R4.format(x=x)


SEC = "('T' || CAST({k} AS VARCHAR) || ' UN Equity')"
UKEY = "((user_id * 2) // 5)"
CKEY = "({c} // 25)"
QEND = "last_day(CAST(date_trunc('quarter', {d}) + INTERVAL 2 MONTH AS DATE))"

VIEWS: dict[str, str] = {}

VIEWS["v_headlines"] = f"""
SELECT 'S' || CAST(event_id // 3 AS VARCHAR) AS suid,
       upper(event_type) || ' Report For Company ' || CAST(user_id % 10 AS VARCHAR) AS headline,
       ts AS arrival,
       'F' || CAST({UKEY} AS VARCHAR) AS figi,
       CASE event_id % 4 WHEN 0 THEN 'BN' WHEN 1 THEN 'BFW' WHEN 2 THEN 'BN' ELSE 'XYZ' END AS wire,
       CASE WHEN event_id % 10 = 0 THEN 'FRENCH' ELSE 'ENGLISH' END AS language
FROM events"""

VIEWS["v_securities"] = f"""
SELECT 'T' || CAST(k AS VARCHAR) || ' ' || listing || ' Equity' AS id,
       'F' || CAST(k AS VARCHAR) || CASE WHEN listing = 'UW' THEN 'W' ELSE '' END AS figi, name, sector, nation, k
FROM (SELECT UNNEST(['UN', 'UW']) AS listing), (SELECT {CKEY.format(c='c_custkey')} AS k, min(c_name) AS name,
             arg_min(c_mktsegment, c_custkey) AS sector, arg_min(c_nationkey, c_custkey) AS nation
      FROM customer GROUP BY 1)"""

VIEWS["v_universe"] = "SELECT id, figi FROM v_securities WHERE sector <> 'AUTOMOBILE'"
VIEWS["v_universe_b"] = "SELECT id, figi FROM v_securities WHERE sector = 'BUILDING'"

VIEWS["v_members"] = """
SELECT 'IDX' AS index_id, id, CAST(DATE '1995-01-01' + CAST(k * 30 AS INTEGER) AS DATE) AS start_date,
       CASE WHEN k % 3 = 0 THEN CAST(DATE '1995-01-01' + CAST(k * 30 AS INTEGER) + INTERVAL 48 MONTH AS DATE) END AS end_date
FROM v_securities"""

VIEWS["v_rebalance_dates"] = """
SELECT DISTINCT CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) AS DATE) AS rebalance_date FROM orders"""

VIEWS["v_reports"] = f"""
SELECT CAST(o_orderdate AS DATE) AS as_of,
       'T' || CAST({CKEY.format(c='o_custkey')} AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN ' UN Equity' ELSE ' UW Equity' END AS id,
       CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) AS DATE) - 1 AS period_end,
       o_orderkey AS seq
FROM orders"""

VIEWS["v_qsums"] = f"""
SELECT {CKEY.format(c='o_custkey')} AS k, {QEND.format(d='CAST(o_orderdate AS DATE)')} AS period_end,
       sum(l_extendedprice) AS rev, sum(l_extendedprice * (1 - l_discount)) AS gross, sum(l_quantity) AS shares
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY 1, 2"""

_PRETAX = "(gross - 0.95 * rev)"
VIEWS["v_facts"] = f"""
SELECT k, 'T' || CAST(k AS VARCHAR) || ' ' || listing || ' Equity' AS id, statement, item_no, item, period_end,
       CAST(period_end + CAST(k % 25 + 20 AS INTEGER) AS DATE) AS publish_date, CAST(value AS DOUBLE) AS value
FROM v_qsums, (SELECT UNNEST(['UN', 'UW']) AS listing),
     (SELECT UNNEST([
        {{'statement': 'is', 'item_no': 1, 'item': '01 Revenue (Adj)', 'sel': 1}},
        {{'statement': 'is', 'item_no': 8, 'item': '08 Gross Profit (Adj)', 'sel': 2}},
        {{'statement': 'is', 'item_no': 19, 'item': '19 Foreign Exch Losses (Gains) (Adj)', 'sel': 3}},
        {{'statement': 'is', 'item_no': 21, 'item': '21 Pretax Income (Loss), Adjusted (Adj)', 'sel': 4}},
        {{'statement': 'is', 'item_no': 28, 'item': '28 Pretax Income (Loss), GAAP', 'sel': 4}},
        {{'statement': 'is', 'item_no': 44, 'item': '44 Basic Weighted Average Number of Shares', 'sel': 5}},
        {{'statement': 'is', 'item_no': 46, 'item': '46 Basic EPS from Continuing Operations', 'sel': 6}},
        {{'statement': 'is', 'item_no': 47, 'item': '47 Basic EPS from Continuing Operations', 'sel': 7}},
        {{'statement': 'bs', 'item_no': 1, 'item': '01 Cash, Cash Equivalents & STI', 'sel': 8}},
        {{'statement': 'bs', 'item_no': 2, 'item': '02 Cash & Cash Equivalents', 'sel': 8}}
     ], recursive := true)) AS it,
     LATERAL (SELECT CASE sel WHEN 1 THEN {r4('rev')} WHEN 2 THEN {r4('gross')} WHEN 3 THEN 0.0
                              WHEN 4 THEN {r4(_PRETAX)} WHEN 5 THEN {r4('shares')}
                              WHEN 6 THEN {r4(_PRETAX + ' / shares')} WHEN 7 THEN {r4('1.01 * ' + _PRETAX + ' / shares')}
                              ELSE {r4('rev * 0.1')} END AS value) AS v"""

VIEWS["v_vintages"] = f"""
SELECT *, publish_date AS revision_date FROM (
  SELECT k, id, statement, item_no, item, period_end, publish_date, value FROM v_facts
  UNION ALL
  SELECT k, id, statement, item_no, item, period_end, CAST(publish_date + 90 AS DATE) AS publish_date,
         {r4('value * 1.02')} AS value
  FROM v_facts WHERE k % 4 = 0)"""

VIEWS["v_estimates"] = f"""
SELECT id, period_end, publish_date, 'A' AS act_est, 0 AS "offset", value FROM v_facts WHERE item_no = 47
UNION ALL
SELECT id, period_end, publish_date, 'E' AS act_est, 1 AS "offset", {r4('next_eps * (1 + ((k % 7) - 3) / 50.0)')} AS value
FROM (SELECT id, k, period_end, publish_date, lead(value) OVER (PARTITION BY id ORDER BY period_end) AS next_eps
      FROM v_facts WHERE item_no = 47)
WHERE next_eps IS NOT NULL"""

VIEWS["v_industries"] = """
SELECT security, valid_from, version, level_1, level_2, level_3, level_3 || '/' || CAST(k % 2 AS VARCHAR) AS level_4
FROM (SELECT id AS security, k, valid_from, version, tag || sector AS level_1, tag || sector || '/' || CAST(nation AS VARCHAR) AS level_2,
             CASE WHEN k % 5 <> 4 THEN tag || sector || '/' || CAST(nation AS VARCHAR) || '/' || CAST(k % 3 AS VARCHAR) END AS level_3
      FROM v_securities, (VALUES (DATE '2023-01-02', 1, 'old '), (DATE '2023-01-02', 2, ''), (DATE '2024-01-15', 1, 'new ')) r(valid_from, version, tag)
      WHERE k % 7 <> 6)"""

VIEWS["v_fx"] = """
SELECT rate_date, ccy_group, version, 1 + ((year(rate_date) * 4 + quarter(rate_date) + ccy_group + 3 * (2 - version)) % 5) / 100.0 AS rate
FROM (SELECT DISTINCT last_day(CAST(date_trunc('quarter', CAST(o_orderdate AS DATE)) + INTERVAL 2 MONTH AS DATE)) AS rate_date FROM orders),
     (VALUES (0, 2), (1, 2), (2, 1), (2, 2)) g(ccy_group, version)
WHERE ccy_group <> 1 OR quarter(rate_date) <> 2"""

VIEWS["v_prices"] = f"""
SELECT {SEC.format(k=UKEY)} AS id, CAST(ts AS DATE) AS date, {r4('100 + avg(value)')} AS px
FROM events GROUP BY 1, 2"""

VIEWS["v_actions"] = f"""
SELECT id, date AS ex_date, CASE WHEN day(date) IN (10, 20) THEN {r4('px / 100')} ELSE 0.0 END AS dividend,
       CASE WHEN day(date) = 15 THEN 2.0 ELSE 1.0 END AS split
FROM v_prices"""

VIEWS["v_total_px"] = """
SELECT p.id, p.date, p.px * coalesce(product(f.factor), 1.0) AS px
FROM v_prices p LEFT JOIN (
  SELECT a.id, a.ex_date, CASE WHEN a.dividend < b.px THEN 1 - a.dividend / b.px ELSE 1.0 END / a.split AS factor
  FROM v_actions a ASOF LEFT JOIN v_prices b ON a.id = b.id AND a.ex_date > b.date) f ON f.id = p.id AND f.ex_date > p.date
GROUP BY p.id, p.date, p.px"""

VIEWS["v_stock_prices"] = f"""
SELECT 'T' || CAST(k AS VARCHAR) || ' ' || listing || ' Equity' AS id, date, px
FROM (SELECT UNNEST(['UN', 'UW']) AS listing),
     (SELECT {CKEY.format(c='o_custkey')} AS k, CAST(o_orderdate AS DATE) AS date, {r4('avg(o_totalprice) / 1000')} AS px
      FROM orders GROUP BY 1, 2)"""

VIEWS["v_calendar"] = """
SELECT date, row_number() OVER (ORDER BY date) AS idx
FROM (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS date FROM events)
WHERE dayofweek(date) NOT IN (0, 6)"""

VIEWS["v_weights_bm"] = """
SELECT p.date, p.id, p.px / t.tot AS w
FROM v_prices p JOIN (SELECT date, sum(px) AS tot FROM v_prices GROUP BY date) t ON p.date = t.date"""

VIEWS["v_beta"] = """
SELECT id, CAST(date_trunc('week', date) AS DATE) AS week, max(date) AS date, arg_max(px, date) / 100.0 AS beta
FROM v_prices GROUP BY 1, 2"""

VIEWS["v_trades"] = f"""
SELECT CAST(ts AS DATE) AS date, {SEC.format(k=UKEY)} AS security,
       CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'SELL' WHEN 'view' THEN 'HOLD' ELSE 'Missing' END AS decision,
       CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS confidence,
       event_id AS seq, event_type
FROM events"""

VIEWS["v_event_days"] = """
SELECT arg_min(date, (-n, date)) AS date
FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1) GROUP BY date_trunc('week', date)"""

VIEWS["v_responses"] = f"""
SELECT 'run' || CAST(event_id % 3 AS VARCHAR) AS run_name, CAST(ts AS DATE) AS date,
       {SEC.format(k=UKEY)} AS security, event_id,
       CASE event_type
         WHEN 'purchase' THEN 'Analysis done.' || chr(10) || '```json' || chr(10) || '{{"decision": "BUY", "confidence score": 8, "reason": "r' || CAST(event_id AS VARCHAR) || '"}}```' || chr(10) || 'End.'
         WHEN 'error' THEN '```json' || chr(10) || '{{"decision": "SELL", "confidence": ' || CAST(event_id % 10 AS VARCHAR) || '}}```'
         WHEN 'view' THEN 'Intro ```json{{"decision": "HOLD", "confidence": 5, "id": ' || CAST(event_id AS VARCHAR) || '}}'
         WHEN 'click' THEN 'I would BUY this stock, ref ' || CAST(event_id AS VARCHAR)
         ELSE 'BUY or SELL? Unclear ' || CAST(event_id AS VARCHAR) END AS response_raw
FROM events"""

VIEWS["v_earnings_responses"] = f"""
SELECT 'run' || CAST(event_id % 3 AS VARCHAR) AS run_name, CAST(ts AS DATE) AS date,
       {SEC.format(k=UKEY)} AS security, event_id,
       CASE event_type
         WHEN 'purchase' THEN '```json{{"earnings": "INCREASE", "magnitude": "SMALL", "confidence": 7}}```'
         WHEN 'error' THEN '```json{{"analyst_direction": "decrease", "analyst_magnitude": "LARGE", "reason": "x", "confidence": "6", "thought_process": "y"}}```'
         WHEN 'view' THEN '{{''earnings'': ''INCREASE'', ''magnitude'': ''VERY LARGE'', ''confidence'': 8, ''reason'': ''text''}}'
         WHEN 'click' THEN '```json{{"earnings": "DECREASE", "magnitude": "FLAT", "confidence": 3}}```'
         ELSE 'no answer' END AS response_raw
FROM events"""

VIEWS["v_agent_results"] = """
SELECT date, security, decision, confidence, seq,
       CASE seq % 4 WHEN 0 THEN 'increase' WHEN 1 THEN 'INCREASE' WHEN 2 THEN ' Increase ' ELSE 'decrease' END AS earning_decision,
       upper(event_type) AS earning_magnitude
FROM v_trades"""

VIEWS["v_ft_text"] = """
SELECT id, period_end,
       CASE WHEN (CAST(regexp_extract(id, '^T(\\d+) ', 1) AS INTEGER) + month(period_end)) % 11 = 0 THEN 'N/A per share'
            ELSE printf('%.4f', value) || ' per share' END AS response
FROM v_estimates WHERE act_est = 'E'"""

VIEWS["v_votes"] = """
SELECT o_orderkey // 9 AS debate, CAST(o_orderkey % 9 + 1 AS INTEGER) AS turn,
       CASE (o_orderkey % 9) % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END AS agent,
       CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'BUY'
            WHEN substr(o_orderpriority, 1, 1) IN ('3', '4') THEN 'SELL' ELSE 'HOLD' END AS vote
FROM orders"""

VIEWS["v_run_metrics"] = """
SELECT l_suppkey % 4 AS worker, l_quantity AS n_tokens, l_shipdate AS start_ts,
       l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS end_ts
FROM lineitem"""

VIEWS["v_done"] = f"""
SELECT DISTINCT CAST(ts AS DATE) AS date, {SEC.format(k=UKEY)} AS security FROM events WHERE event_type = 'purchase'"""

_NAME = re.compile(r"\bv_[a-z_0-9]+\b")


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prepend the CTEs a query body refers to, dependencies first."""
    views = dict(VIEWS)
    if extra:
        views.update(extra)
    order: list[str] = []

    def visit(name: str, stack: tuple[str, ...] = ()) -> None:
        if name in order or name not in views:
            return
        if name in stack:
            raise ValueError(f"cyclic view {name}")
        for dep in _NAME.findall(views[name]):
            if dep != name:
                visit(dep, stack + (name,))
        order.append(name)

    for n in _NAME.findall(body):
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


# Derived oracle views for the PIT chain (mirrors of the operators, not inputs).
VIEWS["v_cal"] = """
SELECT as_of, id, period_end FROM (
  SELECT min(as_of) AS as_of, id, period_end FROM v_reports GROUP BY id, period_end)
WHERE as_of IS NOT NULL AND id IS NOT NULL AND period_end IS NOT NULL AND as_of >= DATE '1996-01-01'"""

VIEWS["v_pit_cand"] = """
SELECT r.as_of, r.id, CAST(last_day(r.latest - to_months(CAST(3 * j AS INTEGER))) AS DATE) AS period_end
FROM (SELECT r.as_of, r.id, max(a.period_end) AS latest
      FROM (SELECT DISTINCT as_of, id FROM v_cal) r
      JOIN (SELECT id, period_end, min(publish_date) AS first_pub FROM v_vintages GROUP BY 1, 2) a
        ON a.id = r.id AND a.first_pub <= r.as_of
      GROUP BY 1, 2) r, (SELECT unnest(range(0, 6)) AS j)"""

VIEWS["v_pit"] = """
SELECT c.as_of, c.id, v.statement, v.item_no, arg_max(v.item, v.publish_date) AS item, c.period_end,
       max(v.publish_date) AS publish_date, arg_max(v.value, (v.publish_date, v.value)) AS value
FROM v_pit_cand c JOIN v_vintages v ON v.id = c.id AND v.period_end = c.period_end
WHERE v.publish_date <= c.as_of
GROUP BY c.as_of, c.id, v.statement, v.item_no, c.period_end"""

VIEWS["v_ranked"] = """
SELECT * FROM (
  SELECT as_of, period_end, dense_rank() OVER (PARTITION BY as_of ORDER BY period_end DESC) AS period_rank
  FROM (SELECT as_of, period_end FROM v_pit WHERE period_end IS NOT NULL GROUP BY 1, 2 HAVING max(abs(value)) > 0))
WHERE period_rank <= 6"""

VIEWS["v_matrix"] = "SELECT l.as_of, l.id, l.statement, l.item_no, l.item, " + ", ".join(
    f"coalesce(max(CASE WHEN r.period_rank = {i + 1} THEN l.value END), 0.0) AS {lab}"
    for i, lab in enumerate(["t", "t_1", "t_2", "t_3", "t_4", "t_5"])
) + """
FROM v_pit l JOIN v_ranked r ON l.as_of = r.as_of AND l.period_end = r.period_end
GROUP BY 1, 2, 3, 4, 5"""


def classify_sql(p: str, n: str, prefix: str) -> str:
    m = f"({n} / {p} - 1)"
    return f"""CASE WHEN {p} = 0 AND {n} = 0 THEN 'INCREASING' WHEN {p} = 0 THEN 'INCREASING' WHEN {n} = 0 THEN 'DECREASING'
            WHEN {m} > 0 THEN 'INCREASING' ELSE 'DECREASING' END AS {prefix}_direction,
       CASE WHEN {p} = 0 AND {n} = 0 THEN 'FLAT' WHEN {p} = 0 OR {n} = 0 THEN 'LARGE' WHEN abs({m}) < 0.02 THEN 'FLAT'
            WHEN abs({m}) <= 0.05 THEN 'SMALL' WHEN abs({m}) <= 0.1 THEN 'LARGE' ELSE 'VERY LARGE' END AS {prefix}_magnitude,
       CAST(CASE WHEN {p} = 0 AND {n} = 0 THEN 0.0 WHEN {p} = 0 THEN {n} WHEN {n} = 0 THEN {p} ELSE {m} END AS DOUBLE) AS {prefix}_difference"""


VIEWS["v_field"] = "SELECT id AS security, as_of AS date, t AS value FROM v_matrix WHERE item_no = 47 AND statement = 'is'"

VIEWS["v_actual"] = f"""
SELECT security, date, current_eps, next_period, {classify_sql('current_eps', 'next_period', 'actual')}
FROM (SELECT security, date, value AS current_eps, lead(value) OVER (PARTITION BY security ORDER BY date) AS next_period
      FROM v_field) WHERE next_period IS NOT NULL"""

VIEWS["v_pairs"] = """
SELECT c.id AS security, c.as_of AS date,
       arg_max(e.value, (e.period_end, e.publish_date)) FILTER (WHERE e.act_est = 'A' AND e."offset" = 0) AS current_reported_eps,
       arg_max(e.value, (e.period_end, e.publish_date)) FILTER (WHERE e.act_est = 'E' AND e."offset" = 1) AS analyst_estimated_eps
FROM (SELECT DISTINCT id, as_of FROM v_cal) c JOIN v_estimates e ON e.id = c.id AND e.publish_date <= c.as_of
GROUP BY c.id, c.as_of"""

VIEWS["v_baseline"] = f"""
SELECT security, date, current_reported_eps, analyst_estimated_eps,
       {classify_sql('current_reported_eps', 'analyst_estimated_eps', 'analyst')}
FROM v_pairs WHERE current_reported_eps IS NOT NULL AND analyst_estimated_eps IS NOT NULL"""

VIEWS["v_compare"] = """
SELECT b.security, b.date, b.current_reported_eps, b.analyst_estimated_eps, b.analyst_direction, b.analyst_magnitude,
       b.analyst_difference, a.current_eps, a.next_period, a.actual_direction, a.actual_magnitude, a.actual_difference
FROM v_baseline b JOIN v_actual a ON a.security = b.security AND a.date = b.date"""

VIEWS["v_finetuned"] = f"""
SELECT security, date, current_reported_eps, analyst_estimated_eps,
       {classify_sql('current_reported_eps', 'analyst_estimated_eps', 'analyst')}
FROM (SELECT c.id AS security, c.as_of AS date, p.current_reported_eps,
             TRY_CAST(substr(t.response, 1, 4) AS DOUBLE) AS analyst_estimated_eps
      FROM v_cal c JOIN v_ft_text t ON t.id = c.id AND t.period_end = c.period_end
      JOIN v_pairs p ON p.security = c.id AND p.date = c.as_of)
WHERE current_reported_eps IS NOT NULL AND analyst_estimated_eps IS NOT NULL"""


# Derived oracle views for the portfolio chain (backtest window below).
BT_START = "DATE '2024-01-01'"
BT_END = "DATE '2024-01-31'"

VIEWS["v_per_day"] = """
SELECT security, date, max(seq) AS seq, arg_max(decision, seq) AS decision
FROM v_trades WHERE decision IN ('BUY', 'SELL') GROUP BY security, date"""

VIEWS["v_pos"] = f"""
SELECT g.date, g.security,
       CASE (SELECT arg_max(p.decision, p.seq) FROM v_per_day p WHERE p.security = g.security AND p.date <= g.date)
         WHEN 'BUY' THEN 'LONG' ELSE 'SHORT' END AS state
FROM (SELECT f.security, CAST(unnest(generate_series(f.start, {BT_END}, INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT security, min(date) AS start FROM v_per_day GROUP BY security) f) g
JOIN v_calendar c ON c.date = g.date"""

VIEWS["v_ls"] = """
SELECT date, security, sum(weight) AS weight FROM (
  SELECT date, security, 1.0 / (1.0 * count(*) OVER (PARTITION BY date)) AS weight FROM v_pos WHERE state = 'LONG'
  UNION ALL
  SELECT date, security, 1.0 / (-1.0 * count(*) OVER (PARTITION BY date)) AS weight FROM v_pos WHERE state = 'SHORT')
GROUP BY date, security"""

VIEWS["v_px"] = f"""
SELECT g.id, g.date,
       (SELECT arg_max(p.px, p.date) FROM v_prices p WHERE p.id = g.id AND p.date <= g.date) AS px
FROM (SELECT f.id, CAST(unnest(generate_series(f.start, {BT_END}, INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT id, min(date) AS start FROM v_prices GROUP BY id) f) g
JOIN v_calendar c ON c.date = g.date"""

VIEWS["v_rets"] = """
SELECT id, date, ret FROM (
  SELECT id, date, px / lag(px) OVER (PARTITION BY id ORDER BY date) - 1 AS ret FROM v_px) WHERE ret IS NOT NULL"""

VIEWS["v_ls_lagged"] = """
SELECT c2.date, w.security, w.weight
FROM v_ls w JOIN v_calendar c1 ON c1.date = w.date JOIN v_calendar c2 ON c2.idx = c1.idx + 1"""

VIEWS["v_bm_lagged"] = """
SELECT c2.date, w.id AS security, w.w AS weight
FROM v_weights_bm w JOIN v_calendar c1 ON c1.date = w.date JOIN v_calendar c2 ON c2.idx = c1.idx + 1"""

VIEWS["v_daily"] = f"""
SELECT c.date,
       coalesce((SELECT sum(l.weight * coalesce(r.ret, 0.0)) FROM v_ls_lagged l
                 LEFT JOIN v_rets r ON r.id = l.security AND r.date = l.date WHERE l.date = c.date), 0.0) AS strategy_return,
       coalesce((SELECT sum(b.weight * coalesce(r.ret, 0.0)) FROM v_bm_lagged b
                 LEFT JOIN v_rets r ON r.id = b.security AND r.date = b.date WHERE b.date = c.date), 0.0) AS benchmark_return
FROM v_calendar c WHERE c.date >= {BT_START} AND c.date <= {BT_END}"""
