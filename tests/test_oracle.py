"""Every query key against its DuckDB oracle on the smallest tables, the
driver contract, and plan properties (no cartesian or nested-loop joins)."""

import duckdb
import pytest

import __spark_entry__ as E
from pitwise.plans import catalog
from tests.conftest import SF_SMALL
from tools.compare import TABLES, digest
from tools.explain import plan_text

# the corpus queries have tests of their own in tests/llm
catalog.load_all()
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_contract_shapes():
    assert len(QUERIES) >= 80
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) >= len(QUERIES) - 3


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["run_name", "date", "strategy_return", "benchmark_return", "strategy_cum", "benchmark_cum"]


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    sdf = QUERIES[key](spark, SF_SMALL).toPandas()
    odf = duck.execute(ORACLES[key]).fetchdf()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert len(sdf) == len(odf)
    assert digest(sdf, 6)[0] == digest(odf, 6)[0]


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, key):
    assert QUERIES[key](spark, SF_SMALL).count() >= 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_has_no_cartesian_or_nested_loop(spark, key):
    plan = plan_text(QUERIES[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_parquet_headlines_prune_and_push(spark):
    df = QUERIES["src_headline_parquet"](spark, SF_SMALL)
    plan = plan_text(df)
    assert "PartitionFilters: [isnotnull(arrival_month" in plan
    assert "PushedFilters: [IsNotNull(arrival), GreaterThanOrEqual(arrival" in plan


def test_scans_prune_columns(spark):
    plan = plan_text(QUERIES["headline_clean"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


@pytest.mark.parametrize("key", ["headline_dedup_id", "headline_dedup_day", "ticker_root_dedup", "statement_dedup_values"])
def test_first_row_per_key_reduces_before_the_shuffle(spark, key):
    # a hot key is cut map-side by a partial aggregate, never gathered whole
    plan = plan_text(QUERIES[key](spark, SF_SMALL))
    assert "partial_min(" in plan
    assert "Window [row_number()" not in plan


@pytest.mark.parametrize("key", ["news_sample", "company_context"])
def test_headline_samples_limit_before_the_shuffle(spark, key):
    plan = plan_text(QUERIES[key](spark, SF_SMALL))
    partial = [ln for ln in plan.splitlines() if "WindowGroupLimit" in ln and "Partial" in ln]
    assert len(partial) >= 2   # per (security, day) before the join, per request before the final window


def test_statement_matrix_pivots_with_fixed_width_buffers(spark):
    plan = plan_text(QUERIES["statement_matrix"](spark, SF_SMALL))
    assert "REPARTITION_BY_COL" in plan          # the explicit (as_of, id) exchange both branches read
    assert "ObjectHashAggregate" not in plan     # no per-group arrays
