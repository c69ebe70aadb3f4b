"""Operators on hand-made frames: quirk decisions (K*), edge cases and properties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitwise.operators import analytics as an
from pitwise.operators import calendar as cal
from pitwise.operators import committee as cm
from pitwise.operators import news
from pitwise.operators import portfolio as pf
from pitwise.operators import scoring as sc
from pitwise.operators import statements as st
from pitwise.operators import training as tr

D = dt.date
T = dt.datetime


def cal_df(spark, days):
    return spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "date date, idx int")


WEEK = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(12) if (D(2024, 1, 1) + dt.timedelta(days=i)).weekday() < 5]


def test_position_state_file_order_and_guards(spark):
    trades = spark.createDataFrame([
        (D(2024, 1, 3), "A", "BUY", 2),
        (D(2024, 1, 2), "A", "SELL", 5),   # earlier date, later in file: wins from Jan 3 on (K9)
        (D(2024, 1, 4), "A", "HOLD", 9),   # HOLD changes nothing
        (D(2024, 1, 5), "A", "Missing", 10),
        (D(2024, 1, 8), "B", "BUY", 1),
    ], "date date, security string, decision string, seq long")
    s = pf.position_state(trades, cal_df(spark, WEEK), "2024-01-09").orderBy("security", "date").collect()
    a = [(r.date, r.state) for r in s if r.security == "A"]
    assert a[0] == (D(2024, 1, 2), "SHORT")
    assert all(state == "SHORT" for _, state in a)
    b = [(r.date, r.state) for r in s if r.security == "B"]
    assert b[0] == (D(2024, 1, 8), "LONG")          # NULL (no row) before the first trade
    assert min(r.date for r in s if r.security == "B") == D(2024, 1, 8)


def test_legs_sum_to_one_and_empty_leg(spark):
    pos = spark.createDataFrame([
        (D(2024, 1, 2), "A", "LONG"), (D(2024, 1, 2), "B", "LONG"), (D(2024, 1, 2), "C", "SHORT"),
        (D(2024, 1, 3), "A", "LONG"),
    ], "date date, security string, state string")
    lw = pf.leg_portfolio(pos, True)
    sw = pf.leg_portfolio(pos, False)
    sums = {r.date: r.s for r in lw.groupBy("date").agg(F.sum("weight").alias("s")).collect()}
    assert sums == {D(2024, 1, 2): 1.0, D(2024, 1, 3): 1.0}
    shorts = {r.date: r.s for r in sw.groupBy("date").agg(F.sum("weight").alias("s")).collect()}
    assert shorts == {D(2024, 1, 2): -1.0}              # empty short leg on Jan 3: no row (K10)
    ls = {(r.date, r.security): r.weight for r in pf.long_short(lw, sw).collect()}
    assert ls[(D(2024, 1, 2), "C")] == -1.0 and ls[(D(2024, 1, 3), "A")] == 1.0


def test_user_weighting_scheme_rejects_negative(spark):
    pos = spark.createDataFrame([(D(2024, 1, 2), "A", "LONG")], "date date, security string, state string")
    with pytest.raises(Exception):
        pf.leg_portfolio(pos, True, lambda signal: -signal).collect()
    ok = pf.leg_portfolio(pos, True, lambda signal, long_leg: signal * 2).collect()
    assert ok[0].weight == 1.0


def test_lag_and_rebalance(spark):
    c = cal_df(spark, WEEK)
    w = spark.createDataFrame([(WEEK[0], "A", 1.0), (WEEK[1], "A", 0.5)], "date date, security string, weight double")
    lagged = {r.date: r.weight for r in pf.lag_weights(w, c, 1).collect()}
    assert lagged == {WEEK[1]: 1.0, WEEK[2]: 0.5}
    held = pf.rebalance_hold(spark.createDataFrame([(d, "A", float(i)) for i, d in enumerate(WEEK)],
                                                   "date date, security string, weight double"), c, "W").collect()
    by_day = {r.date: r.weight for r in held}
    # weights of Friday Jan 5 (index 4) are held over the next week until Friday Jan 12
    assert by_day[D(2024, 1, 8)] == 4.0 and by_day[D(2024, 1, 11)] == 4.0 and D(2024, 1, 2) not in by_day


def test_rebalance_on_event_dates(spark):
    c = cal_df(spark, WEEK)
    w = spark.createDataFrame([(d, "A", float(i)) for i, d in enumerate(WEEK)], "date date, security string, weight double")
    events = spark.createDataFrame([(D(2024, 1, 3),), (D(2024, 1, 3),), (D(2024, 1, 6),), (D(2024, 1, 9),)], "date date")
    held = {r.date: r.weight for r in pf.rebalance_hold(w, c, rebalance_dates=events).collect()}
    # Jan 6 is a Saturday, so its event takes effect on Monday, Jan 8
    assert held == {D(2024, 1, 3): 2.0, D(2024, 1, 4): 2.0, D(2024, 1, 5): 2.0, D(2024, 1, 8): 5.0,
                    D(2024, 1, 9): 6.0, D(2024, 1, 10): 6.0, D(2024, 1, 11): 6.0, D(2024, 1, 12): 6.0}


def test_backtest_skips_securities_without_prices(spark):
    c = cal_df(spark, WEEK)
    trades = spark.createDataFrame([(WEEK[0], "A", "BUY", 1), (WEEK[0], "B", "BUY", 2)],
                                   "date date, security string, decision string, seq long")
    secs = spark.createDataFrame([("A", "FA"), ("B", "FB")], "id string, figi string")
    px = spark.createDataFrame([(d, "A", 100.0 + i) for i, d in enumerate(WEEK)], "date date, id string, px double")
    bm = spark.createDataFrame([(d, "A", 1.0) for d in WEEK], "date date, id string, w double")
    out = an.event_backtest(trades, secs, px.select("id", "date", "px"), bm, c, run_name="r",
                            start=WEEK[0], end=WEEK[-1]).orderBy("date").collect()
    # B has no price series: A alone is the long leg, so the strategy earns A's return
    assert all(abs(r.strategy_return - r.benchmark_return) < 1e-12 for r in out)
    assert out[2].strategy_return == pytest.approx(102.0 / 101.0 - 1)


def test_news_window_half_open(spark):
    req = spark.createDataFrame([("F1", D(2024, 5, 31))], "figi string, as_of date")
    nw = spark.createDataFrame([
        ("s1", "h", T(2024, 2, 29, 0, 0), "F1"),   # first day of the window (add_months clamp): included
        ("s2", "h", T(2024, 2, 28, 23, 59), "F1"),  # before: excluded
        ("s3", "h", T(2024, 5, 30, 23, 0), "F1"),  # included
        ("s4", "h", T(2024, 5, 31, 0, 0), "F1"),   # the as-of day itself: excluded (K16)
        ("s5", "h", T(2024, 4, 1, 0, 0), "F2"),    # other security
    ], "suid string, headline string, arrival timestamp_ntz, figi string")
    got = sorted(r.suid for r in news.news_window(req, nw).collect())
    assert got == ["s1", "s3"]


def test_news_sample_cap_and_seed(spark):
    req = spark.createDataFrame([("F1", D(2024, 3, 1))], "figi string, as_of date")
    nw = spark.createDataFrame([(f"s{i}", "h", T(2024, 2, 1) + dt.timedelta(hours=i), "F1") for i in range(120)],
                               "suid string, headline string, arrival timestamp_ntz, figi string")
    w = news.news_window(req, nw)
    a = {r.suid for r in news.sample_news(w, seed="1").collect()}
    b = {r.suid for r in news.sample_news(w, seed="1").collect()}
    c = {r.suid for r in news.sample_news(w, seed="2").collect()}
    assert len(a) == 50 and a == b and a != c


def test_sample_news_window_equals_direct_sample(spark):
    # a hot security: 80 headlines per day on 4 days, requests whose windows
    # cut through those days at different points
    rows = [(f"s{d}_{i}", "h", T(2024, 2, 26 + d, 0, 0) + dt.timedelta(minutes=17 * i), "F1")
            for d in range(4) for i in range(80)] + [("o1", "h", T(2024, 2, 27, 5), "F2")]
    nw = spark.createDataFrame(rows, "suid string, headline string, arrival timestamp_ntz, figi string")
    req = spark.createDataFrame([("F1", D(2024, 2, 27)), ("F1", D(2024, 2, 28)), ("F1", D(2024, 3, 2)),
                                 ("F2", D(2024, 3, 1))], "figi string, as_of date")
    for seed in ("0", "7"):
        direct = news.sample_news(news.news_window(req, nw), seed=seed)
        pre = news.sample_news_window(req, nw, seed=seed)
        assert sorted(direct.collect()) == sorted(pre.collect())
    counts = {(r.figi, r.as_of): r.n for r in pre.groupBy("figi", "as_of").agg(F.count("*").alias("n")).collect()}
    assert counts == {("F1", D(2024, 2, 27)): 50, ("F1", D(2024, 2, 28)): 50, ("F1", D(2024, 3, 2)): 50,
                      ("F2", D(2024, 3, 1)): 1}


def test_dedupe_ties_and_idempotent(spark):
    raw = spark.createDataFrame([
        ("1", "Same text", T(2024, 1, 1, 9), "F1", "BN", "ENGLISH"),
        ("1", "Same text", T(2024, 1, 1, 8), "F2", "BN", "ENGLISH"),
        ("2", "Same text", T(2024, 1, 1, 7), "F1", "BN", "ENGLISH"),
        ("3", "Other", T(2024, 1, 1, 7), "F1", "BN", "ENGLISH"),
        ("3", "Other", T(2024, 1, 1, 7), "F0", "BN", "ENGLISH"),   # tie on arrival: the remaining columns decide
    ], "suid string, headline string, arrival timestamp_ntz, figi string, wire string, language string")
    once = news.dedupe_by_day_headline(news.dedupe_by_story(raw))
    twice = news.dedupe_by_day_headline(news.dedupe_by_story(once))
    rows = sorted((r.suid, r.figi) for r in once.collect())
    assert rows == [("2", "F1"), ("3", "F0")]
    assert sorted(once.collect()) == sorted(twice.collect())


def test_headline_filter_length_boundary(spark):
    raw = spark.createDataFrame([
        ("1", "x" * 25, T(2024, 1, 6), "F1", "BN", "ENGLISH"),
        ("2", "x" * 26, T(2024, 1, 6), "F1", "BFW", "ENGLISH"),
        ("3", "x" * 26, T(2024, 1, 6), "F1", "XYZ", "ENGLISH"),
        ("4", "x" * 26, T(2024, 1, 4), "F1", "BN", "ENGLISH"),
        ("5", "x" * 26, "bad", "F1", "BN", "ENGLISH"),
    ], "suid string, headline string, arrival string, figi string, wire string, language string")
    members = spark.createDataFrame([("F1",)], "figi string")
    got = [r.suid for r in news.filter_headlines(raw, members, "2024-01-05").collect()]
    assert got == ["2"]


def _vintages(spark):
    return spark.createDataFrame([
        ("A", "is", 47, "47 EPS", D(2023, 9, 30), D(2023, 10, 20), 1.0),
        ("A", "is", 47, "47 EPS", D(2023, 9, 30), D(2024, 1, 20), 1.5),   # restated later
        ("A", "is", 47, "47 EPS", D(2023, 12, 31), D(2024, 2, 10), 2.0),
    ], "id string, statement string, item_no int, item string, period_end date, publish_date date, value double")


def test_pit_asof_never_looks_ahead(spark):
    req = spark.createDataFrame([(D(2024, 1, 10), "A"), (D(2024, 1, 25), "A"), (D(2024, 3, 1), "A")], "as_of date, id string")
    got = {(r.as_of, r.period_end): r.value for r in st.pit_asof(req, _vintages(spark)).collect()}
    assert got == {(D(2024, 1, 10), D(2023, 9, 30)): 1.0, (D(2024, 1, 25), D(2023, 9, 30)): 1.5,
                   (D(2024, 3, 1), D(2023, 9, 30)): 1.5, (D(2024, 3, 1), D(2023, 12, 31)): 2.0}
    assert st.pit_asof(req, _vintages(spark)).where(F.col("publish_date") > F.col("as_of")).count() == 0


def test_pit_asof_stale_security_keeps_its_last_six_periods(spark):
    # last report three years before the request: the relative periods are
    # counted back from the security's latest published quarter, not from as_of
    v = spark.createDataFrame([
        ("B", "is", 47, "47 EPS", D(2020, 3, 31), D(2020, 4, 20), 1.0),
        ("B", "is", 47, "47 EPS", D(2020, 6, 30), D(2020, 7, 20), 2.0),
        ("B", "is", 47, "47 EPS", D(2021, 3, 31), D(2021, 4, 20), 3.0),
    ], "id string, statement string, item_no int, item string, period_end date, publish_date date, value double")
    req = spark.createDataFrame([(D(2024, 5, 1), "B"), (D(2021, 4, 1), "B"), (D(2019, 1, 1), "B")], "as_of date, id string")
    got = sorted((r.as_of, r.period_end, r.value) for r in st.pit_asof(req, v).collect())
    assert got == [(D(2021, 4, 1), D(2020, 3, 31), 1.0), (D(2021, 4, 1), D(2020, 6, 30), 2.0),
                   (D(2024, 5, 1), D(2020, 3, 31), 1.0), (D(2024, 5, 1), D(2020, 6, 30), 2.0),
                   (D(2024, 5, 1), D(2021, 3, 31), 3.0)]
    # the batch's columns are the periods present in it, newest first
    m = st.statement_matrix(st.pit_asof(req, v)).where(F.col("as_of") == D(2024, 5, 1)).first()
    assert (m.t, m.t_1, m.t_2, m.t_3) == (3.0, 2.0, 1.0, 0.0)


def test_reporting_dates_skip_first(spark):
    rep = spark.createDataFrame([(D(2024, 1, 5), "A", D(2023, 12, 31)), (D(2024, 1, 9), "A", D(2023, 12, 31)),
                                 (D(2024, 1, 7), "B", D(2023, 12, 31)), (D(2024, 4, 5), "A", D(2024, 3, 31))],
                                "as_of date, id string, period_end date")
    keep = sorted((r.as_of, r.id) for r in cal.reporting_dates(rep).collect())
    skip = sorted((r.as_of, r.id) for r in cal.reporting_dates(rep, skip_first=True).collect())
    assert keep == [(D(2024, 1, 5), "A"), (D(2024, 1, 7), "B"), (D(2024, 4, 5), "A")]   # K1: all kept by default
    assert skip == [(D(2024, 1, 7), "B"), (D(2024, 4, 5), "A")]


def test_periods_per_date_counts_real_periods(spark):
    req = spark.createDataFrame([(D(2024, 1, 25), "A"), (D(2024, 3, 1), "A")], "as_of date, id string")
    got = {r.as_of: r.n_periods for r in st.periods_per_date(st.pit_asof(req, _vintages(spark))).collect()}
    assert got == {D(2024, 1, 25): 1, D(2024, 3, 1): 2}   # K2: the rest of the six columns are padding


def test_statement_matrix_relative_labels(spark):
    req = spark.createDataFrame([(D(2024, 3, 1), "A")], "as_of date, id string")
    m = st.statement_matrix(st.pit_asof(req, _vintages(spark))).first()
    assert (m.t, m.t_1, m.t_2) == (2.0, 1.5, 0.0)   # short history padded with 0 (K2)


def test_index_members_bounds(spark):
    m = spark.createDataFrame([("I", "A", D(2020, 1, 1), D(2021, 1, 1)), ("I", "B", D(2020, 6, 1), None)],
                              "index_id string, id string, start_date date, end_date date")
    r = spark.createDataFrame([(D(2020, 1, 1),), (D(2021, 1, 1),), (D(2030, 1, 1),)], "rebalance_date date")
    got = sorted((x.rebalance_date, x.id) for x in cal.index_members(m, r).collect())
    assert got == [(D(2020, 1, 1), "A"), (D(2021, 1, 1), "B"), (D(2030, 1, 1), "B")]


def test_committee_k8_and_rounds(spark):
    rows = []
    # debate 0: round 1 BUY, BUY, SELL -> 2 distinct -> stop at round 1, BUY
    rows += [(0, 1, "BUY"), (0, 2, "BUY"), (0, 3, "SELL")]
    # debate 1: rounds 1 and 2 all distinct; round 3 uses HOLD agent's turn-6 vote (K8)
    rows += [(1, 1, "BUY"), (1, 2, "SELL"), (1, 3, "HOLD"), (1, 4, "BUY"), (1, 5, "SELL"), (1, 6, "HOLD"),
             (1, 7, "SELL"), (1, 8, "BUY"), (1, 9, "SELL")]
    # debate 2: incomplete first round
    rows += [(2, 1, "BUY"), (2, 2, "SELL")]
    v = spark.createDataFrame(rows, "debate long, turn int, vote string")
    got = {r.debate: (r.decided_round, r.decision, r.votes_for) for r in cm.committee_consensus(v).collect()}
    assert got[0] == (1, "BUY", 2)
    assert got[1] == (3, "HOLD", 1)   # SELL, BUY, HOLD(turn 6) -> three-way split -> tie-break HOLD
    assert got[2] == (None, None, None)


def test_training_set_rows_as_the_reference_builds_them(spark):
    prompts = spark.createDataFrame([
        (D(2024, 1, 5), "A", "Income Statement:\nx\nBalance Sheet:\ny"),
        (D(2024, 1, 5), "B", "Income Statement:\nz\nBalance Sheet:\nw"),
    ], "as_of date, id string, prompt string")
    pairs = spark.createDataFrame([("A", D(2024, 1, 5), 1.0, 1.23456)],
                                  "security string, date date, current_reported_eps double, analyst_estimated_eps double")
    rows = {r.security: r for r in tr.training_set(prompts, pairs).collect()}
    assert rows["A"].prompt == "Income Statement:\nx\n" + tr.PROMPT_SUFFIX
    assert rows["A"].completion == "1.235"            # the estimate known on the date, rounded to 3
    assert rows["B"].completion is None               # sampled before the lookup, kept without an EPS


def test_price_history_trailing_year(spark):
    days = [D(2023, 3, 1) + dt.timedelta(days=i) for i in range(400)]
    px = spark.createDataFrame([("A", d, 100.0 + i) for i, d in enumerate(days)] + [("B", D(2024, 1, 2), 7.0)],
                               "id string, date date, px double")
    req = spark.createDataFrame([(D(2024, 3, 15), "A"), (D(2024, 3, 15), "C")], "as_of date, id string")
    got = {(r.as_of, r.id): r.prices for r in sc.price_history(req, px).collect()}
    assert list(got) == [(D(2024, 3, 15), "A")]          # no prices, no row (the prompt renders it empty)
    lines = got[(D(2024, 3, 15), "A")].split("\n")
    assert lines[0].startswith("2023-03-15: ") and lines[-1].startswith("2024-03-15: ")   # both ends included
    assert len(lines) == (D(2024, 3, 15) - D(2023, 3, 15)).days + 1


def test_split_stable_and_disjoint(spark):
    df = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(days=i), f"S{i % 7}") for i in range(400)],
                               "date date, security string")
    a = tr.train_test_split(df, ["date", "security"])
    b = tr.train_test_split(df, ["date", "security"])
    assert sorted(a.collect()) == sorted(b.collect())
    train = a.where("split = 'train'").count()
    assert 0.7 < train / 400 < 0.9


def test_chunk_assign_is_a_permutation(spark):
    df = spark.createDataFrame([(i * 7 % 101, f"k{i}") for i in range(101)], "a long, b string")
    out = sc.chunk_assign(df, ["a", "b"], 10).collect()
    ords = sorted(r.ordinal for r in out)
    assert ords == list(range(101))
    first = min(out, key=lambda r: (r.a, r.b))
    assert first.ordinal == 0 and first.chunk == 0 and max(r.chunk for r in out) == 10


def test_batch_score_isolates_rows(spark):
    prompts = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([16, 17, 18, 34, 20])], "k long, prompt string")
    out = {r.k: r for r in sc.batch_score(prompts, sc.length_rule_scorer, keys=["k"], batch_size=2).collect()}
    assert out[1].response_raw is None and "length 17" in out[1].error
    assert out[3].response_raw is None
    assert out[0].error is None and '"decision": "SELL"' in out[0].response_raw  # 16 % 3 == 1


def test_forward_fill_and_returns(spark):
    c = cal_df(spark, WEEK)
    px = spark.createDataFrame([("A", WEEK[0], 100.0), ("A", WEEK[2], 110.0)], "id string, date date, px double")
    f = {r.date: r.px for r in an.forward_fill(px, c, "2024-01-05", "px").collect()}
    assert f == {WEEK[0]: 100.0, WEEK[1]: 100.0, WEEK[2]: 110.0, WEEK[3]: 110.0, WEEK[4]: 110.0}
    r = {x.date: round(x.ret, 6) for x in an.daily_returns(an.forward_fill(px, c, "2024-01-05", "px")).collect()}
    assert r[WEEK[2]] == 0.1 and r[WEEK[1]] == 0.0


def test_cumulative_floor_at_minus_one(spark):
    d = spark.createDataFrame([("r", WEEK[0], 0.1), ("r", WEEK[1], -1.0), ("r", WEEK[2], 0.5)],
                              "run_name string, date date, strategy_return double")
    got = [x.strategy_cum for x in an.cumulative_returns(d, cols=("strategy_return",)).orderBy("date").collect()]
    assert abs(got[0] - 0.1) < 1e-12 and got[1] == -1.0 and got[2] == -1.0


def test_ltm_needs_four_contiguous_quarters(spark):
    f = spark.createDataFrame([("A", "is", 1, D(2023, 3, 31), 1.0), ("A", "is", 1, D(2023, 6, 30), 1.0),
                               ("A", "is", 1, D(2023, 9, 30), 1.0), ("A", "is", 1, D(2023, 12, 31), 1.0),
                               ("A", "is", 1, D(2024, 6, 30), 1.0)],
                              "id string, statement string, item_no int, period_end date, value double")
    got = {r.period_end: r.ltm_value for r in st.ltm(f).collect()}
    assert got[D(2023, 12, 31)] == 4.0 and got[D(2023, 9, 30)] is None and got[D(2024, 6, 30)] is None
