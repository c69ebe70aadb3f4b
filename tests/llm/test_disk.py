"""Disk that the corpus operators take between their steps (findings of round 4)."""

import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pitwise.llm import jaccard_join, tables
from tests.llm import brute
from tests.llm.test_operators import rows_of
from tools.explain import plan_text


def test_long_texts_with_a_common_passage_are_not_verified(docs, monkeypatch):
    """Sets of thousands of n-grams differ little in 64 regions: their pairs were verified on whole texts, written for each pair."""
    settled, settle = {}, jaccard_join.settle
    monkeypatch.setattr(jaccard_join, "settle", lambda df, name: settled.setdefault(name, settle(df, name)))
    rng, rows = random.Random(4), []
    for k in range(8):  # every word is there twice, those of the passage in two texts
        own, passage = [f"w{k}_{i}" for i in range(1200)], [f"c{k // 2}_{i}" for i in range(300)]
        rows.append((k, " ".join([*passage, *own, *rng.sample(own, 1200)])))
    rows += [(100, rows[5][1] + " tail"), (200, rows[6][1][:300]), (201, rows[6][1][:300] + " x")]
    got = jaccard_join.near_duplicates(docs(rows), 3, 80)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute.near_duplicates(rows, 3, 80), key=repr)
    pairs = {(r.x, r.y) for name in ("jaccard-star-pairs", "jaccard-rest-pairs") for r in settled[name].collect()}
    assert pairs == {(5, 100), (200, 201)}


@given(st.lists(st.integers(0, 2**64 - 1), max_size=80), st.lists(st.integers(0, 2**64 - 1), max_size=300), st.lists(st.integers(0, 5000), max_size=300))
@settings(max_examples=300, deadline=None)
def test_maps_bound_what_two_sets_share(both, x, y):
    x, y = np.unique(np.array([*both, *x], np.uint64)), np.unique(np.array([*both, *y], np.uint64))
    bound = jaccard_join.most_common(jaccard_join._map(x), len(x), jaccard_join._map(y), len(y))
    assert len(np.intersect1d(x, y)) <= bound <= min(len(x), len(y))


def test_settled_tables_leave_no_shuffle_files(spark, docs):
    files = lambda: sum("shuffle_" in str(f.getName()) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    for i in range(5):
        tables.settle(spark.range(1000).repartition(7, "id"), "shuffled")
        tables.bitmap(spark.range(1000).select("id"), "id", 10)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before


def test_without_shuffles_few_rows(spark):
    rows = spark.range(5000).selectExpr("if(id = 7, null, id) as k", "repeat('x', 50) as t", "id as _block")
    gone = tables.settle(spark.range(3, 5000, 50).toDF("r"), "gone")
    out = tables.without(rows, "k", gone)
    assert out.columns == ["k", "t", "_block"]
    assert {r._block for r in out.select("_block").collect()} == {i for i in range(5000) if i % 50 != 3} and out.count() == 4900
    # the join on the key is above the map: below the exchange stands the join of blocks
    plan = plan_text(out)
    assert "LeftAnti" not in plan and re.search(r"Exchange hashpartitioning\(_key[^\n]*\n[^\n]*\n?[^\n]*BroadcastHashJoin \[_block", plan)
