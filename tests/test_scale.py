"""Shuffles that grew with the joined facts, not with the input (findings of round 3)."""

import datetime as dt
import json
import os
import re

import pytest

from pitwise.operators import scoring as sc
from pitwise.operators import statements as st
from pitwise.plans.catalog import QUERIES, load_all
from pitwise.sources import pit_store as ps
from tests.conftest import SF_SMALL
from tools.explain import plan_text

D = dt.date
load_all()
SCHEMA = "id string, statement string, item_no int, item string, period_end date, publish_date date, value double"


@pytest.mark.parametrize("key", ["statement_matrix", "statement_long", "statement_nonzero", "statement_any_positive", "statement_dedup_values",
                                 "pit_nest", "pit_explode", "company_snapshot"])
def test_selected_facts_are_not_shuffled(spark, key):
    """Above the join of requests and vintages, only the period ranks are dealt (by as_of)."""
    lines = plan_text(QUERIES[key](spark, SF_SMALL)).splitlines()
    joins = [i for i, ln in enumerate(lines) if re.search(r"Join.*publish_date#\d+ <= as_of#", ln)]
    assert len(joins) == 2   # the matrix and its ranks
    for at in joins:
        depth, above = lines[at].index("Sort" if "SortMergeJoin" in lines[at] else "Broadcast"), []
        for ln in reversed(lines[:at]):
            m = re.search(r"[A-Z]", ln)
            if m and m.start() < depth:
                depth = m.start()
                above.append(ln[depth:])
        dealt = [ln for ln in above if ln.startswith("Exchange")]
        assert all(re.match(r"Exchange hashpartitioning\(as_of#\d+(, period_end#\d+)?, \d+\)", ln) for ln in dealt)


def test_prompts_compute_the_matrix_once(spark):
    scans = lambda key: len(re.findall(r"FileScan parquet \[l_orderkey", plan_text(QUERIES[key](spark, SF_SMALL))))
    assert scans("prompt_table") == scans("statement_matrix") > 0


def test_vintages_of_one_day_and_between(spark):
    v = spark.createDataFrame([
        ("A", "is", 1, "01 X", D(2023, 12, 31), D(2024, 1, 20), 1.0), ("A", "is", 1, "01 X", D(2023, 12, 31), D(2024, 1, 20), 3.0),
        ("A", "is", 1, "01 X", D(2023, 12, 31), D(2024, 1, 20), None), ("A", "is", 1, "01 X", D(2023, 12, 31), D(2024, 2, 1), 2.0),
        ("A", "is", 1, "01 X", D(2023, 12, 31), None, 9.0), ("A", "is", 2, None, D(2023, 11, 30), D(2024, 1, 25), 5.0)], SCHEMA)
    req = spark.createDataFrame([(D(2024, 1, 19), "A"), (D(2024, 1, 20), "A"), (D(2024, 1, 31), "A"), (D(2024, 2, 1), "A"), (D(2024, 2, 1), "A")],
                                "as_of date, id string")
    got = sorted((r.as_of, r.item_no, r.publish_date, r.value) for r in st.pit_asof(req, v).collect())
    assert got == [(D(2024, 1, 20), 1, D(2024, 1, 20), 3.0), (D(2024, 1, 31), 1, D(2024, 1, 20), 3.0), (D(2024, 1, 31), 2, D(2024, 1, 25), 5.0),
                   (D(2024, 2, 1), 1, D(2024, 2, 1), 2.0), (D(2024, 2, 1), 2, D(2024, 1, 25), 5.0)]


@pytest.mark.parametrize("months", [0, 1, 11, 12, 13, 30])
def test_price_windows_across_years(spark, months):
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(0, 1500, 3)]
    px = spark.createDataFrame([("A", d, float(i)) for i, d in enumerate(days)], "id string, date date, px double")
    asked = [D(2020, 1, 1), D(2021, 1, 1), D(2022, 12, 31), D(2023, 3, 31), D(2030, 1, 1)]
    got = {r.as_of: r.prices.split("\n") for r in sc.price_history(spark.createDataFrame([(d, "A") for d in asked], "as_of date, id string"), px, months).collect()}
    for a in asked:
        y, m = divmod(a.year * 12 + a.month - 1 - months, 12)
        last = ((D(y, m + 1, 28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)).day
        first = D(y, m + 1, min(a.day, last))
        assert got.get(a, []) == [f"{d}: {i:.4f}" for i, d in enumerate(days) if first <= d <= a]


def test_store_is_nested_in_one_pass_and_compressed(spark, tmp_path):
    cols = "as_of date, id string, statement string, item_no int, item string, " + ", ".join(f"{c} double" for c in st.PERIOD_LABELS)
    m = spark.createDataFrame([(D(2024, 1, 5), "A", "is", 2, "02 Y", *map(float, range(6))), (D(2024, 1, 5), "A", "is", 1, "01 X", *map(float, range(6, 12))),
                               (D(2024, 1, 6), "B", "xx", 1, "01 X", *[0.0] * 6)], cols)
    nested = st.pit_nest(m)
    assert "Expand" not in plan_text(nested)
    got = {r.id: r for r in nested.collect()}
    assert json.loads(got["A"].is_json) == {lab: {"01 X": 6.0 + i, "02 Y": float(i)} for i, lab in enumerate(st.PERIOD_LABELS)}
    assert got["A"].bs_json is None and got["B"].is_json is None and got["B"].bs_json is None
    ps.write_store(nested, str(tmp_path / "store"))
    assert all(f.endswith(".json.gz") for f in os.listdir(tmp_path / "store") if f.startswith("part-"))
    assert st.pit_explode(ps.read_store(spark, str(tmp_path / "store"))).count() == 12
