"""Total returns and the sample that is cut before prompts are rendered: hand-made cases."""

import datetime as dt

import pytest

from pitwise.operators import analytics as an
from pitwise.operators import scoring as sc
from pitwise.operators import training as tr

D = dt.date
ACTIONS = "id string, ex_date date, dividend double, split double"


def adjusted(spark, prices, actions):
    p = spark.createDataFrame(prices, "id string, date date, px double")
    return {(r.id, r.date): r.px for r in an.total_return_prices(p, spark.createDataFrame(actions, ACTIONS)).collect()}


def test_dividends_and_splits_scale_all_earlier_prices(spark):
    days = [D(2024, 1, d) for d in (2, 3, 4, 5)]
    got = adjusted(spark, [("A", d, x) for d, x in zip(days, (100.0, 110.0, 54.0, 60.0), strict=True)] + [("B", days[0], 5.0), ("C", days[0], None)],
                   [("A", days[2], 2.0, 2.0), ("A", days[3], 1.5, None), ("A", days[3], 1.5, 1.0), ("Z", days[0], 1.0, 2.0)])
    late, early = 1 - 3.0 / 54, (1 - 2.0 / 110) / 2      # two dividends of one day add up
    assert got[("A", days[3])] == 60.0 and got[("A", days[2])] == pytest.approx(54 * late)
    assert got[("A", days[1])] == pytest.approx(110 * late * early) and got[("A", days[0])] == pytest.approx(100 * late * early)
    assert got[("B", days[0])] == 5.0 and got[("C", days[0])] is None and len(got) == 6


def test_actions_between_and_outside_trading_days(spark):
    got = adjusted(spark, [("A", D(2024, 1, 5), 10.0), ("A", D(2024, 1, 8), 5.0)],
                   [("A", D(2024, 1, 6), None, 2.0),      # a Saturday
                    ("A", D(2023, 12, 1), 1.0, 3.0),      # before the first price
                    ("A", D(2024, 1, 8), 10.0, 1.0),      # not below the price before it
                    ("A", D(2024, 1, 8), None, -1.0), (None, D(2024, 1, 8), 1.0, 2.0)])
    assert got == {("A", D(2024, 1, 5)): pytest.approx(5.0), ("A", D(2024, 1, 8)): 5.0}
    none = spark.createDataFrame([], ACTIONS)
    p = spark.createDataFrame([("A", D(2024, 1, 5), 10.0)], "id string, date date, px double")
    assert an.total_return_prices(p, none).collect() == p.collect() and an.total_return_prices(p.limit(0), none).count() == 0


def test_backtest_earns_total_returns(spark):
    """A split two for one halves the price: no return; the same run without actions loses half."""
    days = [D(2024, 1, d) for d in (2, 3, 4, 5)]
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, idx int")
    px = spark.createDataFrame([("A", d, x) for d, x in zip(days, (10.0, 10.0, 5.0, 5.0), strict=True)], "id string, date date, px double")
    bench = spark.createDataFrame([("A", d, 1.0) for d in days], "id string, date date, w double")
    w = bench.selectExpr("id as security", "date", "w as weight")
    actions = spark.createDataFrame([("A", days[2], 0.0, 2.0)], ACTIONS)
    ret = lambda p: [r.benchmark_return for r in an.portfolio_returns(
        w.limit(0), w, an.daily_returns(an.forward_fill(p, cal, days[-1], "px")), cal, lag=1, start=days[0], end=days[-1]).orderBy("date").collect()]
    assert ret(px) == pytest.approx([0.0, 0.0, -0.5, 0.0])
    assert ret(an.total_return_prices(px, actions)) == pytest.approx([0.0, 0.0, 0.0, 0.0])


def test_statements_are_sampled_before_prompts_are_rendered(spark):
    cols = "as_of date, id string, statement string, item string, item_no int, t double, t_1 double, t_2 double, t_3 double, t_4 double, t_5 double"
    values = lambda x: (x, 0.0, 0.0, 0.0, 0.0, 0.0)
    rows = [(D(2024, 1, d), s, "is", "is_Revenue", 1, *values(float(d * (s != "S3")))) for d in range(1, 7) for s in ("S1", "S2", "S3")]
    matrix = spark.createDataFrame(rows, cols)
    meta = spark.createDataFrame([("S1", "One", "x")], "id string, name string, sector string")
    every = sc.prompt_table(matrix, meta)
    assert every.count() == 12                            # S3 has all-zero items only, and so no prompt
    want = tr.sample_records(every.selectExpr("as_of as date", "id as security", "prompt"), n=5).collect()
    kept = tr.sampled_statements(matrix, n=5)
    assert kept.select("as_of", "id").distinct().count() == 5
    got = sc.prompt_table(kept, meta).selectExpr("as_of as date", "id as security", "prompt").collect()
    assert sorted(got) == sorted(want)
