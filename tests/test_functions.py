"""Column functions: classifier bands, direction rule, JSON extraction, keyword rule, text helpers."""

import math

import pytest
from pyspark.sql import functions as F

from pitwise.functions.classify import direction_word, interpret_change
from pitwise.functions.numeric import round_half_up
from pitwise.functions.responses import json_block, keyword_decision, number_value, quoted_value
from pitwise.functions.text import drop_first_line, fill_template, text_after, text_before


def _classify(spark, pairs, signed=False):
    df = spark.createDataFrame(pairs, "a double, b double")
    r = df.select(interpret_change(F.col("a"), F.col("b"), signed).alias("c")).select("c.*").collect()
    return [(x.direction, x.band, x.magnitude) for x in r]


def reference_change(t, t1):
    """Plain-Python statement of the reference's rule, used as the expected value."""
    if t == 0.0 or t1 == 0.0:
        if t == 0.0 and t1 == 0.0:
            return "INCREASING", "FLAT", 0.0
        if t == 0.0:
            return "INCREASING", "LARGE", t1
        return "DECREASING", "LARGE", t
    m = t1 / t - 1
    d = "INCREASING" if m > 0 else "DECREASING"
    a = abs(m)
    band = "FLAT" if a < 0.02 else "SMALL" if a <= 0.05 else "LARGE" if a <= 0.1 else "VERY LARGE"
    return d, band, m


PAIRS = [(0.0, 0.0), (0.0, 1.5), (2.0, 0.0), (1.0, 1.01), (1.0, 0.98), (1.0, 1.02), (1.0, 1.05), (1.0, 1.0500001),
         (1.0, 1.1), (1.0, 1.2), (-1.0, -1.2), (-1.0, -0.5), (0.5, -0.5), (3.0, 3.0), (100.0, 89.0)]


def test_interpret_change_matches_rule(spark):
    got = _classify(spark, PAIRS)
    for (a, b), (d, band, m) in zip(PAIRS, got):
        ed, eb, em = reference_change(a, b)
        assert (d, band) == (ed, eb), (a, b)
        assert math.isclose(m, em, abs_tol=1e-12)


def test_negative_prior_inverts_direction_unless_signed(spark):
    # K4: -1 -> -0.5 is an improvement, but the ratio rule calls it DECREASING
    assert _classify(spark, [(-1.0, -0.5)])[0][0] == "DECREASING"
    assert _classify(spark, [(-1.0, -0.5)], signed=True)[0][0] == "INCREASING"


def test_direction_word(spark):
    df = spark.createDataFrame([("INCREASE",), ("increase",), (" Increasing ",), ("decrease",), (None,), ("UP",)], "x string")
    got = [r[0] for r in df.select(direction_word(F.col("x"))).collect()]
    assert got == ["INCREASING", "INCREASING", "INCREASING", "DECREASING", "DECREASING", "DECREASING"]


RESPONSES = [
    ('Intro.\n```json\n{"decision": "BUY", "confidence": 7}```\nTail.', "BUY", "Intro.Tail."),
    ('```json{"decision": "SELL"', None, ""),                       # unterminated, invalid JSON -> raw
    ('```json{"decision": "HOLD"}', "HOLD", ""),                    # unterminated but complete object
    ("```json{'decision': 'BUY'}```", None, ""),                    # single quotes rejected (K12)
    ("plain text BUY", None, None),                                 # no block
]


@pytest.mark.parametrize("raw,decision,additional", RESPONSES)
def test_json_block_shapes(spark, raw, decision, additional):
    df = spark.createDataFrame([(raw,)], "r string")
    row = df.select(json_block(F.col("r")).alias("b")).select("b.*").first()
    got = None if row.parsed is None else row.parsed.get("decision")
    assert got == decision
    assert row.additional == additional


def test_keyword_decision(spark):
    df = spark.createDataFrame([("I BUY",), ("BUY and SELL",), ("nothing",), ("HOLD it",), ("buy lower",)], "t string")
    got = [r[0] for r in df.select(keyword_decision(F.col("t"))).collect()]
    assert got == ["BUY", "Missing", "Missing", "HOLD", "Missing"]


def test_text_fallback_patterns(spark):
    raw = "{'earnings': 'INCREASE', 'magnitude': 'VERY LARGE', 'confidence': 8}"
    df = spark.createDataFrame([(raw,), ('"confidence": "12"',), ("none",)], "r string")
    rows = df.select(quoted_value(F.col("r"), "magnitude").alias("m"), number_value(F.col("r"), "confidence").alias("c")).collect()
    assert (rows[0].m, rows[0].c) == ("VERY LARGE", "8")  # K13: space kept, all digits kept
    assert rows[1].c == "12"
    assert (rows[2].m, rows[2].c) == (None, None)


def test_text_helpers(spark):
    df = spark.createDataFrame([("Income:\na\nBalance Sheet:\nb",)], "p string")
    r = df.select(text_before(F.col("p"), "Balance Sheet:").alias("b"), text_after(F.col("p"), "Balance Sheet:").alias("a"),
                  drop_first_line(F.col("p")).alias("d"),
                  fill_template("x={x};y={y}", x=F.lit(1), y=F.lit(None)).alias("t")).first()
    assert r.b == "Income:\na\n" and r.a == "\nb" and r.d == "a\nBalance Sheet:\nb" and r.t == "x=1;y="


def test_round_half_up(spark):
    df = spark.createDataFrame([(1.23455,), (-1.5,), (2.675,)], "x double")
    got = [r[0] for r in df.select(round_half_up(F.col("x"), 2)).collect()]
    assert got == [1.23, -1.5, 2.68]  # 2.675 * 100.0 rounds to 267.5 in IEEE arithmetic
