"""Model responses to reports: JSON extraction, trade reports, earnings
reports, agent normalisation and trade projections (DOM5-8, DOM10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.functions.classify import direction_word
from pitwise.functions.responses import first_key, json_block, keyword_decision, number_value, quoted_value


def parse_responses(df: DataFrame, raw_col: str = "response_raw") -> DataFrame:
    """DOM5 on every row: adds ``response`` (string map or NULL), ``json_text``
    and ``additional_context``; the raw text is always kept (M9)."""
    b = json_block(F.col(raw_col))
    return df.withColumn("__b", b).select(
        *df.columns,
        F.col("__b.parsed").alias("response"),
        F.col("__b.json_text").alias("json_text"),
        F.col("__b.additional").alias("additional_context"),
    )


def trade_report(parsed: DataFrame, raw_col: str = "response_raw") -> DataFrame:
    """DOM6: decision key when the response parsed (``Missing`` when the key
    is absent); else exactly one of BUY/SELL/HOLD in the text, else
    ``Missing``.  Confidence from ``confidence score`` then ``confidence``.
    Row-wise, so a missing response cannot shift other rows (K11)."""
    r = F.col("response")
    decision = F.when(r.isNotNull(), F.coalesce(r.getItem("decision"), F.lit("Missing"))).otherwise(
        keyword_decision(F.col(raw_col)))
    confidence = F.when(r.isNotNull(), first_key(r, "confidence score", "confidence"))
    keep = [c for c in parsed.columns if c not in ("response", "json_text", "additional_context", raw_col)]
    return parsed.select(*keep, decision.alias("decision"), confidence.alias("confidence"))


def earnings_report(parsed: DataFrame, raw_col: str = "response_raw") -> DataFrame:
    """DOM7: three response shapes to (analyst_direction, analyst_magnitude,
    confidence): ``earnings/magnitude``, ``analyst_direction/analyst_magnitude``
    or free text read with key patterns (K13 fix); one direction rule (K14)."""
    r = F.col("response")
    raw = F.col(raw_col)
    direction = F.coalesce(r.getItem("earnings"), r.getItem("analyst_direction"), quoted_value(raw, "earnings"))
    magnitude = F.coalesce(r.getItem("magnitude"), r.getItem("analyst_magnitude"), quoted_value(raw, "magnitude"))
    confidence = F.coalesce(r.getItem("confidence"), number_value(raw, "confidence"))
    keep = [c for c in parsed.columns if c not in ("response", "json_text", "additional_context", raw_col)]
    return parsed.select(*keep, direction_word(direction).alias("analyst_direction"),
                         magnitude.alias("analyst_magnitude"), confidence.alias("confidence"))


def agent_normalise(agent_rows: DataFrame) -> DataFrame:
    """DOM8: agent earning decisions to the common direction words."""
    return agent_rows.select(
        "date", "security", "decision", "confidence",
        direction_word(F.col("earning_decision")).alias("analyst_direction"),
        F.col("earning_magnitude").alias("analyst_magnitude"),
    )


def trade_projection(agent_rows: DataFrame, trade_only: bool = True) -> DataFrame:
    """DOM10: the trade report columns, optionally with the earnings fields."""
    cols = ["date", "security", "decision", "confidence"]
    if not trade_only:
        cols += ["earning_decision", "earning_magnitude"]
    return agent_rows.select(*cols)
