"""As-of join, dated industries, signal and portfolio hooks, benchmark columns
and distributed quantiles: hand-made cases and plain versions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pitwise.operators import analytics as an
from pitwise.operators import news, scoring
from pitwise.operators import portfolio as pf
from pitwise.operators import statements as st
from pitwise.operators.asof import asof_join

D = dt.date


def day(n):
    return D(2024, 1, 1) + dt.timedelta(days=n)


def plain_asof(left, right, greatest=False):
    out = []
    for k, t, tag in left:
        seen = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        best = max(seen, key=lambda r: (r[3] if greatest else (r[1], r[2], r[3])), default=None)
        out.append((k, t, tag, best and best[3]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("greatest", [False, True])
@pytest.mark.parametrize("sliced", [None, "week", "month"])
def test_asof_against_a_plain_scan(spark, greatest, sliced):
    """Ties, repeated probes, null keys and times, a hot key, slices without an observation."""
    rng = random.Random(7)
    right = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([day(rng.randrange(120)), None]), rng.randrange(3), float(rng.randrange(50))) for _ in range(120)]
    left = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([day(rng.randrange(-5, 140)), None]), rng.randrange(4)) for _ in range(150)]
    got = asof_join(spark.createDataFrame(left, "k string, t date, tag int"), spark.createDataFrame(right, "k string, at date, version int, x double"), ["k"], "t", "at", ["x"],
                    version=("version",), greatest=greatest, slice_of=None if sliced is None else (lambda c: F.trunc(c, sliced)))
    assert got.columns == ["k", "t", "tag", "x"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_asof(left, right, greatest)


def test_asof_of_timestamps_and_empty_sides(spark):
    left = spark.createDataFrame([("a", dt.datetime(2024, 3, 1, 12), 1), ("a", dt.datetime(2024, 3, 1, 9), 2)], "k string, t timestamp, n int")
    right = spark.createDataFrame([("a", dt.datetime(2024, 1, 5, 10), 1.0), ("a", dt.datetime(2024, 3, 1, 10), 2.0)], "k string, at timestamp, x double")
    assert {r.n: r.x for r in asof_join(left, right, ["k"], "t", "at", ["x"]).collect()} == {1: 2.0, 2: 1.0}
    assert [r.x for r in asof_join(left, right.limit(0), ["k"], "t", "at", ["x"]).collect()] == [None, None]
    assert asof_join(left.limit(0), right, ["k"], "t", "at", ["x"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(left.withColumn("x", F.lit(1)), right, ["k"], "t", "at", ["x"])


def test_two_rates_of_one_day_neither_double_nor_leak(spark):
    facts = spark.createDataFrame([("A", "is", 1, day(n), 10.0) for n in (9, 10, 11)], "id string, statement string, item_no int, period_end date, value double")
    fx = spark.createDataFrame([(0, day(5), 2.0, 1), (0, day(10), 3.0, 2), (0, day(10), 4.0, 1)], "ccy_group int, rate_date date, rate double, version int")
    ccy = spark.createDataFrame([("A", 0)], "id string, ccy_group int")
    got = sorted((r.period_end, r.rate, r.value) for r in st.fx_convert(facts, fx, ccy, version=("version",)).collect())
    assert got == [(day(9), 2.0, 20.0), (day(10), 3.0, 30.0), (day(11), 3.0, 30.0)]
    assert sorted(r.rate for r in st.fx_convert(facts, fx, ccy).collect()) == [2.0, 4.0, 4.0]


def test_exposure_keeps_what_has_no_class(spark):
    w = spark.createDataFrame([(day(1), "A", 0.5), (day(1), "B", 0.5), (day(9), "A", 1.0)], "date date, security string, weight double")
    ind = spark.createDataFrame([("A", day(0), "tech", "soft", None, None), ("A", day(5), "bank", None, None, None), ("B", day(5), "oil", None, None, None)],
                                "security string, valid_from date, level_1 string, level_2 string, level_3 string, level_4 string")
    got = {(r.date, r.level, r.industry): r.net_weight for r in an.industry_exposure(w, ind).collect()}
    assert got[day(1), 1, "tech"] == 0.5 and got[day(1), 1, "unclassified"] == 0.5 and got[day(9), 1, "bank"] == 1.0
    assert got[day(9), 4, "unclassified"] == 1.0 and sum(v for (d, lv, _), v in got.items() if (d, lv) == (day(1), 2)) == 1.0
    secs = spark.createDataFrame([("A", "tech", 3)], "id string, sector string, nation int")
    two = {(r.level, r.industry): r.gross_weight for r in an.sector_exposure(w.where(F.col("date") == day(1)), secs).collect()}
    assert two == {(1, "tech"): 0.5, (1, "unclassified"): 0.5, (2, "tech/3"): 0.5, (2, "unclassified"): 0.5}


@pytest.mark.parametrize(("row", "text"), [
    (("A", day(2), 1.0, day(2)), "several signals"), (("A", day(50), 1.0, day(1)), "without trading"), (("A", day(3), 1.0, day(4)), "published later"),
    (("A", day(3), float("nan"), None), "no number"), ((None, day(3), 1.0, None), "without security")])
def test_each_breach_of_a_signal_is_an_error(spark, row, text):
    cal = spark.createDataFrame([(day(n), n) for n in range(10)], "date date, idx int")
    good = [("A", day(2), 1.0, day(1)), ("B", day(2), None, None)]
    schema = "security string, date date, signal double, published date"
    assert sorted(map(tuple, pf.checked_signal(spark.createDataFrame(good, schema), cal).collect()), key=repr) == [("A", day(2), 1.0), ("B", day(2), None)]
    with pytest.raises(Exception, match=text):
        pf.checked_signal(spark.createDataFrame([*good, row], schema), cal).collect()


def test_user_portfolio_carries_its_state(spark):
    cal = spark.createDataFrame([(day(n), n) for n in range(6)], "date date, idx int")
    w = spark.createDataFrame([(day(1), "A", 0.3), (day(2), "A", 0.3), (day(2), "B", -1.0), (day(4), "B", None), (day(1), None, 9.0)], "date date, security string, weight double")
    got = {(r.security, r.date): round(r.weight, 9) for r in pf.user_portfolio(w, cal, day(4), pf.turnover_limit(0.2)).collect()}
    assert got == {("A", day(1)): 0.2, ("A", day(2)): 0.3, ("A", day(3)): 0.1, ("A", day(4)): 0.0, ("B", day(2)): -0.2, ("B", day(3)): 0.0, ("B", day(4)): 0.0}

    def third_day(held, target, state):
        state["n"] = state.get("n", 0) + 1
        return 1.0 if state["n"] == 3 else 0.0

    assert {(r.security, r.date) for r in pf.user_portfolio(w, cal, day(4), third_day).collect() if r.weight} == {("A", day(3)), ("B", day(4))}
    with pytest.raises(Exception, match="finite"):
        pf.user_portfolio(w, cal, day(4), lambda *_: math.nan).collect()


def test_benchmark_figures(spark):
    s, b = [0.01, -0.02, 0.03, 0.0], [0.02, -0.01, 0.01, 0.01]
    d = spark.createDataFrame([("r", day(k), x, y) for k, (x, y) in enumerate(zip(s, b, strict=True))] + [("one", day(0), 0.1, 0.1), ("none", day(0), None, 0.1)],
                              "run_name string, date date, strategy_return double, benchmark_return double")
    got = {r.run_name: r for r in an.benchmark_statistics(d).collect()}
    mean = lambda x: sum(x) / len(x)
    cov = lambda x, y: sum((p - mean(x)) * (q - mean(y)) for p, q in zip(x, y, strict=True)) / (len(x) - 1)
    e = [x - y for x, y in zip(s, b, strict=True)]
    assert math.isclose(got["r"].beta, cov(s, b) / cov(b, b)) and math.isclose(got["r"].tracking_error, math.sqrt(cov(e, e) * 252))
    assert math.isclose(got["r"].information_ratio, mean(e) / math.sqrt(cov(e, e)) * math.sqrt(252))
    assert math.isclose(got["r"].excess_return, math.prod(1 + x for x in s) - math.prod(1 + x for x in b))
    assert got["one"].beta is None and got["one"].tracking_error is None and "none" not in got
    roll = {r.date: r for r in an.rolling_benchmark(d.where("run_name = 'r'"), 3).collect()}
    assert roll[day(1)].beta is None and math.isclose(roll[day(3)].beta, cov(s[1:], b[1:]) / cov(b[1:], b[1:]))


@pytest.mark.parametrize("cells", [2, 7, 256])
def test_distributed_ntile_is_ntile(spark, cells):
    rng = random.Random(cells)
    rows = [(rng.choice(["x", "x", "y", None]), rng.choice([None, 1.0, 1.0, rng.gauss(0, 9), float(rng.randrange(5))]), k) for k in range(300)] + [("small", 1.0, 1000), ("small", 2.0, 1001)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    want = df.selectExpr("*", "ntile(5) over (partition by g order by v, id) as bucket")
    assert sorted(map(tuple, an.distributed_ntile(df, 5, "g", "v", "id", cells=cells).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_rows_that_were_lost(spark):
    """A prompt without metadata; the least of several FIGIs; news without a date."""
    m = spark.createDataFrame([(day(1), i, "is", 1, "Sales", *[1.0 + k for k in range(6)]) for i in ("A", "B")],
                              "as_of date, id string, statement string, item_no int, item string, " + ", ".join(f"{p} double" for p in st.PERIOD_LABELS))
    secs = spark.createDataFrame([("A", "n", "s")], "id string, name string, sector string")
    assert {r.id for r in scoring.prompt_table(m, secs).collect()} == {"A", "B"}
    two = spark.createDataFrame([("A", "F2"), ("A", "F1")], "id string, figi string")
    assert [r.figi for r in pf.map_to_figi(spark.createDataFrame([("A",)], "security string"), two).collect()] == ["F1"]
    rows = [(f"s{k}", "text", dt.datetime(2020 + k % 4, 1, 1 + k % 28), "F1" if k < 200 else "F2") for k in range(220)]
    headlines = spark.createDataFrame(rows, "suid string, headline string, arrival timestamp, figi string")
    req = spark.createDataFrame([("F1", None), ("F2", None), ("F3", None), ("F1", D(2021, 1, 20))], "figi string, as_of date")
    whole = news.news_window(req, headlines)
    assert whole.where("as_of is null and figi = 'F1'").count() == 200 and whole.where("as_of is null and figi = 'F2'").count() == 20
    got = news.sample_news_window(req, headlines, n=50)
    want = news.sample_news(whole, n=50)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("as_of is null and figi = 'F1'").count() == 50 and got.where("as_of is not null").count() > 0
