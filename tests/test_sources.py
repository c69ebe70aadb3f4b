"""Sources and sinks: round trips through files in a fresh scratch folder."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from pitwise.session import scratch_path
from pitwise.sources import data_items as di
from pitwise.sources import headlines as hl
from pitwise.sources import pit_store as ps
from pitwise.sources import results as rs
from pitwise.sources import trades as tl
from tools.explain import plan_text


def test_headline_csv_multiline_and_glob(spark):
    path = scratch_path(spark, "csv")
    os.makedirs(path)
    with open(os.path.join(path, "2024-01-02_EID80001.csv"), "w") as f:
        f.write("SUID,Headline,TimeOfArrival,Assigned_ID_BB_GLOBAL,WireName,LanguageString\n")
        f.write('1,"Line one\nline two, with comma",2024-01-02 10:00:00,F1,BN,ENGLISH\n')
        f.write('2,"Quote ""inside""",not a time,F2,BFW,ENGLISH\n')
    with open(os.path.join(path, "other.csv"), "w") as f:
        f.write("SUID,Headline\n9,ignored\n")
    rows = hl.to_canonical(hl.read_headline_csv(spark, path)).orderBy("suid").collect()
    assert [r.suid for r in rows] == ["1", "2"]
    assert rows[0].headline == "Line one\nline two, with comma"
    assert rows[1].headline == 'Quote "inside"' and rows[1].arrival is None


def test_trade_list_by_header(spark):
    path = scratch_path(spark, "trades")
    os.makedirs(path)
    with open(os.path.join(path, "t.csv"), "w") as f:
        f.write("Extra,Date,Security,Decision,Confidence\nx,2024-01-03,A US Equity,BUY,7\n")
    r = tl.read_trade_list(spark, path).first()
    assert (r.date, r.security, r.decision, r.confidence) == (dt.date(2024, 1, 3), "A US Equity", "BUY", "7")


def test_training_set_sink(spark):
    path = scratch_path(spark, "train")
    df = spark.createDataFrame([("p1", "0.123", "train"), ("p2", "1.000", "test")], "prompt string, completion string, split string")
    rs.write_training_set(df, path)
    lines = []
    for root, _, files in os.walk(path):
        for fn in files:
            if fn.endswith(".json"):
                with open(os.path.join(root, fn)) as f:
                    lines += [json.loads(x) for x in f if x.strip()]
    assert sorted(x["prompt"] for x in lines) == ["p1", "p2"]
    assert all(set(x) == {"prompt", "completion"} for x in lines)


def test_materialise_or_reuse(spark):
    path = scratch_path(spark, "mat")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert rs.materialise(spark, path, build).count() == 5
    assert rs.materialise(spark, path, build).count() == 5
    assert len(calls) == 1
    rs.materialise(spark, path, build, force_refresh=True)
    assert len(calls) == 2


def test_chunked_log_files(spark):
    path = scratch_path(spark, "log")
    df = spark.range(250).select(F.lit(dt.date(2024, 1, 1)).alias("date"), F.col("id"))
    rs.write_chunked_log(df.repartition(1), path, log_at=100)
    files = [f for f in os.listdir(os.path.join(path, "year=2024")) if f.endswith(".json")]
    assert len(files) == 3


def test_data_pack_prunes_by_item(spark):
    path = scratch_path(spark, "pack")
    items = spark.createDataFrame([("px_last", "A", dt.date(2024, 1, d), float(d)) for d in range(1, 11)] +
                                  [("beta", "A", dt.date(2024, 1, 1), 1.0)], "item string, id string, date date, value double")
    di.write_data_pack(items, path)
    got = di.load_item(spark, path, "px_last", "2024-01-03", "2024-01-05")
    assert sorted(r.value for r in got.collect()) == [3.0, 4.0, 5.0]
    plan = plan_text(got)
    assert "PartitionFilters: [isnotnull(item" in plan


def test_store_prices_epoch_ms(spark):
    path = scratch_path(spark, "store")
    os.makedirs(path)
    px = json.dumps({"Price": {"1704153600000": 101.5}})
    with open(os.path.join(path, "s.json"), "w") as f:
        f.write(json.dumps({"as_of": "2024-01-10", "id": "A", "is": None, "bs": None, "px": px,
                            "mt": {"name": "a", "figi": "F", "sector": "S"}}) + "\n")
    r = ps.explode_prices(ps.read_store(spark, path)).first()
    assert (r.date, r.px) == (dt.date(2024, 1, 2), 101.5)


def test_results_envelope_and_rows(spark):
    from pitwise.plans.q_sources import RESULT_SCHEMA

    res = spark.createDataFrame([("r", dt.date(2024, 1, 2), "A", 1, "x"), ("r", dt.date(2024, 1, 3), "B", 2, "y")],
                                "run_name string, date date, security string, event_id long, response_raw string")
    for layout in ("rows", "envelope"):
        path = scratch_path(spark, layout)
        rs.save_run(res, path, model="m", run_date="2024-02-01", layout=layout)
        back = rs.load_results(spark, path, RESULT_SCHEMA).select("run_name", "date", "security", "event_id", "response_raw")
        assert sorted(back.collect()) == sorted(res.collect())


def test_results_envelope_splits_a_hot_day(spark):
    from pitwise.plans.q_sources import RESULT_SCHEMA

    rows = [("r", dt.date(2024, 1, 2), f"S{i}", i, "x") for i in range(50)] + [("r", dt.date(2024, 1, 3), "B", 99, "y")]
    res = spark.createDataFrame(rows, "run_name string, date date, security string, event_id long, response_raw string")
    path = scratch_path(spark, "envelope-hot")
    rs.save_run(res, path, model="m", run_date="2024-02-01", layout="envelope", envelope_results=10)
    env = spark.read.json(path)
    sizes = [r.n for r in env.select(F.size("results").alias("n")).collect()]
    assert len(sizes) >= 6 and sum(sizes) == 51          # the hot day is spread over several envelopes
    back = rs.load_results(spark, path, RESULT_SCHEMA).select("run_name", "date", "security", "event_id", "response_raw")
    assert sorted(back.collect()) == sorted(res.collect())
