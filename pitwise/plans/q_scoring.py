"""Query keys for prompts, scoring, run bookkeeping, training-set assembly
and the committee vote (DOM14-15, U4-U8, JN4, JN15, WIN13, AGG16-17, SRT7, SET4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.operators import calendar as cal
from pitwise.operators import committee as cm
from pitwise.operators import scoring as sc
from pitwise.operators import training as tr
from pitwise.operators.stages import Stage, run_stages
from pitwise.plans import fixtures as fx
from pitwise.plans.catalog import query
from pitwise.plans.oracle_views import VIEWS
from pitwise.plans.q_estimates import pairs
from pitwise.plans.q_statements import matrix
from pitwise.session import scratch_path

_T = ["t", "t_1", "t_2", "t_3", "t_4", "t_5"]
_LINE = ("replace(substr(item, 4), ' (Adj)', '') || ': ' || "
         + " || ' | ' || ".join(f"printf('%.4f', {c})" for c in _T))

VIEWS["v_prompts"] = f"""
SELECT l.as_of, l.id,
       'Company: ' || s.name || chr(10) || 'Sector: ' || s.sector || chr(10) || 'Date: ' || strftime(l.as_of, '%Y-%m-%d')
       || chr(10) || 'Income Statement:' || chr(10) || coalesce(l.income, '') || chr(10) || 'Balance Sheet:' || chr(10)
       || coalesce(l.balance, '') || chr(10) || 'Historical Price:' || chr(10) || coalesce(h.prices, '') AS prompt
FROM (SELECT as_of, id,
             string_agg(line, chr(10) ORDER BY item_no) FILTER (WHERE statement = 'is') AS income,
             string_agg(line, chr(10) ORDER BY item_no) FILTER (WHERE statement = 'bs') AS balance
      FROM (SELECT *, {_LINE} AS line FROM (
              SELECT *, row_number() OVER (PARTITION BY as_of, id, statement, {', '.join(_T)} ORDER BY item_no, item) AS rn
              FROM v_matrix)
            WHERE rn = 1 AND ({' OR '.join(f'{c} <> 0' for c in _T)}))
      GROUP BY as_of, id) l
JOIN v_securities s ON s.id = l.id
LEFT JOIN (
  SELECT r.as_of, r.id, string_agg(strftime(p.date, '%Y-%m-%d') || ': ' || printf('%.4f', p.px), chr(10) ORDER BY p.date) AS prices
  FROM (SELECT DISTINCT as_of, id FROM v_matrix) r JOIN v_stock_prices p
    ON p.id = r.id AND p.date >= CAST(r.as_of - INTERVAL 12 MONTH AS DATE) AND p.date <= r.as_of
  GROUP BY r.as_of, r.id) h ON h.as_of = l.as_of AND h.id = l.id"""


def _stub_sql(p: str, resp: str, err: str) -> str:
    n = f"length({p})"
    return (f"CASE WHEN {n} % 17 = 0 THEN NULL ELSE '```json' || chr(10) || '{{\"decision\": \"' || "
            f"CASE {n} % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END || '\", \"confidence\": ' || "
            f"CAST({n} % 10 AS VARCHAR) || '}}```' END AS {resp}, "
            f"CASE WHEN {n} % 17 = 0 THEN 'ValueError: scorer failed on a prompt of length ' || CAST({n} AS VARCHAR) END AS {err}")


def prompts(spark, d):
    return sc.prompt_table(matrix(spark, d), fx.v_securities(spark, d), prices=fx.v_stock_prices(spark, d))


@query("prompt_table", "SELECT as_of, id, prompt, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM v_prompts")
def prompt_table(spark, d):
    p = prompts(spark, d)
    return p.select("as_of", "id", "prompt", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@query("batch_score", f"SELECT as_of, id, {_stub_sql('prompt', 'response_raw', 'error')} FROM v_prompts")
def batch_score(spark, d):
    return sc.batch_score(prompts(spark, d), sc.length_rule_scorer, keys=["as_of", "id"], batch_size=16,
                          n_partitions=spark.sparkContext.defaultParallelism)


_STAGE2 = "'Previous analysis:' || chr(10) || coalesce(response_1, '') || chr(10) || chr(10) || prompt"


@query("staged_score", f"""
SELECT as_of, id, response_1, error_1, {_stub_sql(_STAGE2, 'response_2', 'error_2')}
FROM (SELECT as_of, id, prompt, {_stub_sql('prompt', 'response_1', 'error_1')} FROM v_prompts)""")
def staged_score(spark, d):
    return sc.staged_score(prompts(spark, d), sc.length_rule_scorer, keys=["as_of", "id"], stages=2, batch_size=16)


# The five stages of the reference's analyst graph, with wording of our own.
_FIVE = [
    ("financial_report", "Analyse the statements of a company.\n{prompt}", "'Analyse the statements of a company.' || chr(10) || prompt"),
    ("cleaned_headlines", "Keep what is about {id}.\n{headlines}", "'Keep what is about ' || id || '.' || chr(10) || coalesce(headlines, '')"),
    ("news_report", "Sum up the news for the sector {sector}.\n{cleaned_headlines}",
     "'Sum up the news for the sector ' || sector || '.' || chr(10) || coalesce(cleaned_headlines, '')"),
    ("senior_report", "Sector {sector}\nStatements: {financial_report}\nNews: {news_report}",
     "'Sector ' || sector || chr(10) || 'Statements: ' || coalesce(financial_report, '') || chr(10) || 'News: ' || coalesce(news_report, '')"),
    ("final_output", "Put this into fields, with the headlines {cleaned_headlines}:\n{senior_report}",
     "'Put this into fields, with the headlines ' || coalesce(cleaned_headlines, '') || ':' || chr(10) || coalesce(senior_report, '')"),
]


def _five_sql() -> str:
    sql = "SELECT p.as_of, p.id, p.prompt, s.sector, s.name || ' reports' AS headlines FROM v_prompts p JOIN v_securities s ON s.id = p.id"
    for name, _, expr in _FIVE:
        sql = f"SELECT *, {_stub_sql(f'({expr})', name, name + '_error')} FROM ({sql})"
    return f"SELECT as_of, id, {', '.join(f'{n}, {n}_error' for n, _, _ in _FIVE)} FROM ({sql})"


@query("staged_score_five", _five_sql())
def staged_score_five(spark, d):
    """U8: five stages, of which the later ones read several earlier outputs."""
    secs = fx.v_securities(spark, d).select("id", "sector", F.concat("name", F.lit(" reports")).alias("headlines"))
    base = prompts(spark, d).join(secs, "id")
    return run_stages(base, [Stage(n, t, sc.length_rule_scorer) for n, t, _ in _FIVE], scratch_path(spark, "stages"), keys=["as_of", "id"], batch_size=16)


@query("resume_anti", """
SELECT DISTINCT t.date, t.security FROM v_trades t
WHERE NOT EXISTS (SELECT 1 FROM v_done d WHERE d.date = t.date AND d.security = t.security)""")
def resume_anti(spark, d):
    todo = fx.v_trades(spark, d).select("date", "security").distinct()
    return sc.resume_todo(todo, fx.v_done(spark, d))


CHUNK = 500


@query("chunk_assign", f"""
SELECT date, security, decision, confidence, seq, ordinal, CAST(floor(ordinal / {CHUNK}) AS BIGINT) AS chunk
FROM (SELECT *, row_number() OVER (ORDER BY date, security, seq) - 1 AS ordinal FROM v_trades)""")
def chunk_assign(spark, d):
    return sc.chunk_assign(fx.v_trades(spark, d).drop("event_type"), ["date", "security", "seq"], CHUNK)


@query("scoring_throughput", """
SELECT count(DISTINCT worker) AS n_workers, sum(n_tokens) AS total_tokens,
       CAST(epoch(max(end_ts)) - epoch(min(start_ts)) AS BIGINT) AS elapsed_s,
       round(sum(n_tokens) / CAST(epoch(max(end_ts)) - epoch(min(start_ts)) AS BIGINT), 6) AS tokens_per_s
FROM v_run_metrics""")
def scoring_throughput(spark, d):
    t = sc.throughput(fx.v_run_metrics(spark, d))
    return t.select("n_workers", "total_tokens", "elapsed_s", F.round("tokens_per_s", 6).alias("tokens_per_s"))


# ------------------------------------------------------------ training
VIEWS["v_train_records"] = """
SELECT p.as_of AS date, p.id AS security, p.prompt
FROM v_prompts p
WHERE p.id IN (SELECT id FROM v_universe) AND p.id NOT IN (SELECT id FROM v_universe_b)"""

_SAMPLE = """
SELECT * FROM v_train_records
ORDER BY md5(strftime(date, '%Y-%m-%d') || '|' || '42'), date, security LIMIT 10000"""

_BUCKET = ("(instr('0123456789abcdef', substr(md5(CAST(date AS VARCHAR) || '|' || security), 1, 1)) - 1) * 16 + "
           "(instr('0123456789abcdef', substr(md5(CAST(date AS VARCHAR) || '|' || security), 2, 1)) - 1)")


def train_records(spark, d):
    univ = cal.universe_minus(fx.v_universe(spark, d), fx.v_universe_b(spark, d), "id")
    p = cal.keep_universe(prompts(spark, d), univ, "id")
    return p.select(F.col("as_of").alias("date"), F.col("id").alias("security"), "prompt")


@query("training_sample", f"SELECT date, security FROM ({_SAMPLE})")
def training_sample(spark, d):
    return tr.sample_records(train_records(spark, d), n=tr.MAX_RECORDS, seed="42").select("date", "security")


@query("train_test_split", f"""
SELECT date, security, CASE WHEN {_BUCKET} < 205 THEN 'train' ELSE 'test' END AS split FROM v_train_records""")
def train_test_split(spark, d):
    s = train_records(spark, d).select("date", "security")
    return tr.train_test_split(s, ["date", "security"])


@query("training_set", f"""
SELECT date, security, split_part(prompt, 'Balance Sheet:', 1) || chr(10) || 'The next period EPS is:' AS prompt,
       CASE WHEN e.analyst_estimated_eps IS NOT NULL
            THEN CAST(floor(e.analyst_estimated_eps * 1000.0 + 0.5) / 1000.0 AS VARCHAR) END AS completion,
       CASE WHEN {_BUCKET} < 205 THEN 'train' ELSE 'test' END AS split
FROM ({_SAMPLE}) s LEFT JOIN v_pairs e USING (security, date)""")
def training_set(spark, d):
    univ = cal.universe_minus(fx.v_universe(spark, d), fx.v_universe_b(spark, d), "id")
    m = tr.sampled_statements(cal.keep_universe(matrix(spark, d), univ, "id"), seed="42")
    p = sc.prompt_table(m, fx.v_securities(spark, d), prices=fx.v_stock_prices(spark, d))
    return tr.training_set(p, pairs(spark, d), seed="42")


# ----------------------------------------------------------- committee
_V = ", ".join(f"max(CASE WHEN turn = {t} THEN vote END) AS v{t}" for t in range(1, 10))


def _nd(a, b, c):
    return f"(1 + CASE WHEN {b} <> {a} THEN 1 ELSE 0 END + CASE WHEN {c} <> {a} AND {c} <> {b} THEN 1 ELSE 0 END)"


def _maj(a, b, c):
    return f"CASE WHEN {a} = {b} OR {a} = {c} THEN {a} WHEN {b} = {c} THEN {b} ELSE 'HOLD' END"


_R = {1: ("v1", "v2", "v3"), 2: ("v4", "v5", "v6"), 3: ("v7", "v8", "v6")}
_C1 = "v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL"
_C2 = "v4 IS NOT NULL AND v5 IS NOT NULL AND v6 IS NOT NULL"
_C3 = "v7 IS NOT NULL AND v8 IS NOT NULL AND v9 IS NOT NULL"


@query("committee_consensus", f"""
WITH p AS (SELECT debate, {_V} FROM v_votes GROUP BY debate),
r AS (SELECT *, CASE WHEN {_C1} AND {_nd(*_R[1])} <= 2 THEN 1
                     WHEN {_C1} AND {_C2} AND {_nd(*_R[2])} <= 2 THEN 2
                     WHEN {_C1} AND {_C2} AND {_C3} THEN 3 END AS decided_round FROM p),
d AS (SELECT *, CASE decided_round WHEN 1 THEN v1 WHEN 2 THEN v4 WHEN 3 THEN v7 END AS r1,
                CASE decided_round WHEN 1 THEN v2 WHEN 2 THEN v5 WHEN 3 THEN v8 END AS r2,
                CASE decided_round WHEN 1 THEN v3 WHEN 2 THEN v6 WHEN 3 THEN v6 END AS r3,
                CASE decided_round WHEN 1 THEN {_maj(*_R[1])} WHEN 2 THEN {_maj(*_R[2])} WHEN 3 THEN {_maj(*_R[3])} END AS decision
      FROM r)
SELECT debate, decided_round, decision,
       CASE WHEN decided_round IS NOT NULL THEN
         (CASE WHEN r1 = decision THEN 1 ELSE 0 END) + (CASE WHEN r2 = decision THEN 1 ELSE 0 END)
         + (CASE WHEN r3 = decision THEN 1 ELSE 0 END) END AS votes_for
FROM d""")
def committee_consensus(spark, d):
    return cm.committee_consensus(fx.v_votes(spark, d))
