"""FLT13: the whole record of a (date, security), not its counts alone (finding F2 of round 4)."""

import datetime as dt

from pitwise.operators import scoring as sc
from pitwise.operators import statements as st
from pitwise.plans.catalog import QUERIES, load_all
from tests.conftest import SF_SMALL

D = dt.date
load_all()


def test_record_holds_statements_prices_and_metadata(spark):
    cols = "as_of date, id string, statement string, item_no int, item string, " + ", ".join(f"{c} double" for c in st.PERIOD_LABELS)
    zero = [0.0] * 6
    m = spark.createDataFrame([
        (D(2024, 3, 5), "A", "is", 47, "47 EPS", 1.5, 1.0, *zero[:4]), (D(2024, 3, 5), "A", "is", 46, "46 EPS XO", 1.5, 1.0, *zero[:4]),
        (D(2024, 3, 5), "A", "is", 2, "02 Cost (Adj)", -2.0, *zero[:5]), (D(2024, 3, 5), "A", "is", 9, "09 None", *zero),
        (D(2024, 3, 5), "A", "bs", 1, "01 Cash", 1.5, 1.0, *zero[:4]), (D(2024, 3, 6), "B", "bs", 1, "01 Cash", *zero)], cols)
    secs = spark.createDataFrame([("A", "FA", "Firm A", "TECH", 1)], "id string, figi string, name string, sector string, nation int")
    px = spark.createDataFrame([("A", D(2023, 3, 4), 1.0), ("A", D(2024, 3, 5), 3.0), ("A", D(2023, 3, 5), 2.0), ("A", D(2024, 3, 6), 4.0)], "id string, date date, px double")
    got = {r.id: r for r in sc.company_records(m, secs, px).collect()}
    pad = " | 0.0000" * 4
    assert got["A"].asDict() == {
        "as_of": D(2024, 3, 5), "id": "A", "figi": "FA", "name": "Firm A", "sector": "TECH", "n_items": 5, "eps_t": 1.5,
        "sec_fs": f"Income Statement:\nCost: -2.0000 | 0.0000{pad}\nEPS XO: 1.5000 | 1.0000{pad}\nBalance Sheet:\nCash: 1.5000 | 1.0000{pad}",
        "stock_price": "Historical Price:\n2023-03-05: 2.0000\n2024-03-05: 3.0000"}
    assert (got["B"].name, got["B"].n_items, got["B"].eps_t) == (None, 1, None)
    assert (got["B"].sec_fs, got["B"].stock_price) == ("Income Statement:\n\nBalance Sheet:\n", "Historical Price:\n")


def test_snapshot_has_the_parts_that_prompts_have(spark):
    snap = QUERIES["company_snapshot"](spark, SF_SMALL)
    assert {"figi", "name", "sector", "sec_fs", "stock_price"} <= set(snap.columns)
    prompts = {(r.as_of, r.id): r.prompt for r in QUERIES["prompt_table"](spark, SF_SMALL).collect()}
    rows = snap.collect()
    assert rows and {(r.as_of, r.id) for r in rows} >= set(prompts)
    for r in rows:
        if (r.as_of, r.id) in prompts:
            assert prompts[r.as_of, r.id].endswith(f"{r.sec_fs}\n{r.stock_price}")
