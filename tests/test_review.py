"""Rows that must not be lost, and values that must not be known yet."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.functions.dates import fiscal_quarter_end
from pitwise.functions.responses import json_block
from pitwise.operators import analytics as an
from pitwise.operators import estimates as es
from pitwise.operators import portfolio as pf
from pitwise.operators import statements as st
from pitwise.operators import training as tr
from pitwise.plans import fixtures as fx
from pitwise.plans.q_estimates import pairs
from pitwise.session import ensure_checkpoint_dir
from pitwise.sources import results as rs
from tests.conftest import SF_SMALL

D = dt.date


def test_estimate_pair_knows_nothing_published_later(spark):
    est = spark.createDataFrame(
        [("A", D(2022, 3, 31), D(2022, 5, 1), "A", 0, 1.0), ("A", D(2022, 6, 30), D(2022, 8, 1), "A", 0, 2.0),
         ("A", D(2022, 6, 30), D(2022, 9, 1), "A", 0, 2.5), ("A", D(2022, 3, 31), D(2022, 5, 1), "E", 1, 1.1),
         ("A", D(2022, 6, 30), D(2022, 8, 1), "E", 1, 2.1)],
        "id string, period_end date, publish_date date, act_est string, offset int, value double")
    cal = spark.createDataFrame([("A", D(2022, 4, 1)), ("A", D(2022, 5, 1)), ("A", D(2022, 7, 31)), ("A", D(2022, 8, 1)), ("A", D(2023, 1, 1)), ("B", D(2023, 1, 1))],
                                "id string, as_of date")
    got = {(r.security, r.date): (r.current_reported_eps, r.analyst_estimated_eps) for r in es.eps_pair(cal, est).collect()}
    assert got == {("A", D(2022, 5, 1)): (1.0, 1.1), ("A", D(2022, 7, 31)): (1.0, 1.1), ("A", D(2022, 8, 1)): (2.0, 2.1), ("A", D(2023, 1, 1)): (2.5, 2.1)}


def test_every_pair_of_the_fixture_was_published(spark):
    p = pairs(spark, SF_SMALL).where(F.col("current_reported_eps").isNotNull())
    est = fx.v_estimates(spark, SF_SMALL).where("act_est = 'A'").select(F.col("id").alias("security"), "publish_date", "value")
    known = p.join(est, "security").where((F.col("publish_date") <= F.col("date")) & (F.col("value") == F.col("current_reported_eps")))
    assert p.count() > 0 and known.select("security", "date").distinct().count() == p.count()


def test_forward_fill_carries_weekend_observations(spark):
    cal = spark.createDataFrame([(D(2024, 1, d),) for d in (4, 5, 8, 9)], "date date")  # Thursday to Tuesday
    obs = spark.createDataFrame([("A", D(2024, 1, 4), 1.0), ("A", D(2024, 1, 6), 2.0), ("A", D(2024, 1, 7), 3.0), ("B", D(2024, 1, 6), 9.0)], "id string, date date, px double")
    got = sorted((r.id, r.date.day, r.px) for r in an.forward_fill(obs, cal, "2024-01-09", "px").collect())
    assert got == [("A", 4, 1.0), ("A", 5, 1.0), ("A", 8, 3.0), ("A", 9, 3.0), ("B", 8, 9.0), ("B", 9, 9.0)]


def test_pit_keeps_filers_with_other_fiscal_days(spark):
    v = spark.createDataFrame(
        [("A", "is", 1, "x", D(2022, 9, 24), D(2022, 10, 20), 4.0), ("A", "is", 1, "x", D(2022, 6, 25), D(2022, 7, 20), 3.0),
         ("B", "is", 1, "x", D(2022, 10, 1), D(2022, 11, 1), 8.0), ("B", "is", 1, "x", D(2022, 10, 1), D(2022, 11, 1), 9.0)],
        "id string, statement string, item_no int, item string, period_end date, publish_date date, value double")
    req = spark.createDataFrame([(D(2022, 12, 1), "A"), (D(2022, 12, 1), "B")], "as_of date, id string")
    got = sorted((r.id, r.period_end, r.value) for r in st.pit_asof(req, v).collect())
    assert got == [("A", D(2022, 6, 30), 3.0), ("A", D(2022, 9, 30), 4.0), ("B", D(2022, 9, 30), 9.0)]
    days = spark.createDataFrame([(D(2023, 7, 1),), (D(2023, 9, 30),), (D(2023, 1, 31),), (D(2023, 4, 30),)], "d date")
    assert [r[0] for r in days.select(fiscal_quarter_end(F.col("d"))).collect()] == [D(2023, 6, 30), D(2023, 9, 30), D(2023, 3, 31), D(2023, 6, 30)]


@pytest.mark.parametrize("layout", ["rows", "envelope"])
def test_results_without_date_or_run_are_kept(spark, tmp_path, layout):
    df = spark.createDataFrame([("r1", D(2024, 1, 1), "A", "x"), ("r1", None, "B", "y"), (None, None, "C", None), ("r1", None, None, None)],
                               "run_name string, date date, security string, response_raw string")
    path = str(tmp_path / layout)
    rs.save_run(df, path, layout=layout, run_date="2024-02-01", envelope_results=1)
    schema = T.StructType([f for f in df.schema.fields if f.name != "run_name"])
    back = rs.load_results(spark, path, schema)
    assert sorted(map(repr, back.select(*df.columns).collect())) == sorted(map(repr, df.collect()))


def test_materialise_raises_what_is_no_absence(spark, tmp_path):
    path = str(tmp_path / "t")
    assert rs.materialise(spark, path, lambda: spark.range(3)).count() == 3
    assert rs.materialise(spark, path, lambda: spark.range(9)).count() == 3
    for f in (tmp_path / "t").glob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        rs.materialise(spark, path, lambda: spark.range(9))
    assert all(f.read_bytes() == b"broken" for f in (tmp_path / "t").glob("*.parquet"))


def test_metadata_and_rates_lose_no_row(spark):
    secs = spark.createDataFrame([("A", "n")], "id string, name string")
    df = spark.createDataFrame([("A",), ("B",)], "id string")
    assert sorted(st.attach_metadata(df, secs).collect()) == [("A", "n"), ("B", None)]
    assert st.unmatched_keys(df, secs).collect() == [("B",)]
    facts = spark.createDataFrame([(i, "is", n, D(2022, m, 28), 10.0) for i, n, m in (("A", 1, 1), ("A", 1, 3), ("A", 1, 5), ("A", 44, 1), ("B", 1, 5), ("A", 1, 9))],
                                  "id string, statement string, item_no int, period_end date, value double")
    rates = spark.createDataFrame([(0, D(2022, 2, 1), 2.0), (0, D(2022, 4, 1), 3.0)], "ccy_group int, rate_date date, rate double")
    out = st.fx_convert(facts, rates, spark.createDataFrame([("A", 0)], "id string, ccy_group int")).collect()
    got = sorted((r.id, r.item_no, r.period_end.month, r.rate, r.value) for r in out)
    assert got == sorted([("A", 1, 1, None, None), ("A", 44, 1, None, 10.0), ("A", 1, 3, 2.0, 20.0), ("A", 1, 5, 3.0, 30.0), ("A", 1, 9, 3.0, 30.0), ("B", 1, 5, None, None)], key=repr) or \
        set(got) == {("A", 1, 1, None, None), ("A", 44, 1, None, 10.0), ("A", 1, 3, 2.0, 20.0), ("A", 1, 5, 3.0, 30.0), ("A", 1, 9, 3.0, 30.0), ("B", 1, 5, None, None)}


def test_a_wiped_out_year_stays_at_minus_one(spark):
    d = spark.createDataFrame([("r", D(2024, 1, 1 + i), x) for i, x in enumerate((0.1, -1.0, 0.1))], "run_name string, date date, ret double")
    row = an.yearly_performance(d, "ret").first()
    assert row.total_return == -1.0 and row.max_drawdown == -1.0


def test_rebalance_on_an_event_between_trading_days(spark):
    cal = spark.createDataFrame([(D(2024, 1, d),) for d in (4, 5, 8, 9)], "date date")
    events = spark.createDataFrame([(D(2024, 1, 4),), (D(2024, 1, 6),), (D(2024, 1, 20),)], "date date")
    got = {r.date.day: r.anchor.day for r in pf.rebalance_anchor(cal, rebalance_dates=events).collect()}
    assert got == {4: 4, 5: 4, 8: 8, 9: 8}


def test_ltm_of_vintages_stays_within_a_date(spark):
    rows = [(D(2023, a, 1), "A", "is", 1, D(2022, 3 * q, 28), float(a)) for a in (2, 5) for q in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "as_of date, id string, statement string, item_no int, period_end date, value double")
    out = st.ltm(df, by=("as_of",)).where("ltm_value is not null").collect()
    assert {(r.as_of.month, r.ltm_value) for r in out} == {(2, 8.0), (5, 20.0)}


def test_completion_is_the_shortest_text(spark):
    df = spark.createDataFrame([(1.5,), (2.0,), (0.12345,), (None,)], "x double")
    assert [r[0] for r in df.select(tr.completion_text(F.col("x"))).collect()] == ["1.5", "2.0", "0.123", None]


def test_json_block_of_closed_open_and_repeated_fences(spark):
    raws = ['a ```json\n{"x": "1"}``` b ```json{"y": 2}```', 'p ```json{"x": 1', "no fence }```", '```json{"a": {"b": 1}}```', None]
    df = spark.createDataFrame([(r,) for r in raws], "raw string").select(json_block(F.col("raw")).alias("b"))
    got = [(r.b.json_text, r.b.additional) for r in df.collect()]
    assert got == [('{"x": "1"}', 'a  b ```json{"y": 2}```'), ('{"x": 1', "p "), (None, None), ('{"a": {"b": 1}}', ""), (None, None)]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_fixture_branches_have_rows(spark):
    """Off-calendar prices, both listings, missing rates and weekend events are there to be exercised."""
    days = fx.v_calendar(spark, SF_SMALL)
    assert fx.v_prices(spark, SF_SMALL).join(days, "date", "left_anti").count() > 0
    assert fx.v_beta(spark, SF_SMALL).join(days, "date", "left_anti").count() > 0
    events = fx.v_event_days(spark, SF_SMALL)
    assert 0 < events.count() < days.count()
    rates = fx.v_fx(spark, SF_SMALL)
    assert rates.where("ccy_group = 1").count() < rates.where("ccy_group = 0").count()
    assert fx.v_reports(spark, SF_SMALL).join(fx.v_securities(spark, SF_SMALL), "id", "left_anti").count() == 0
    seq = fx.v_trades(spark, SF_SMALL).select("seq")
    assert seq.distinct().count() == seq.count()
