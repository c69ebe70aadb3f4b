"""Column functions over free-form model responses (DOM5, SC9-SC11, SC20, SC27)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fence mark and trade words of the reference.
JSON_OPEN = "```json"
TRADE_WORDS = ("BUY", "SELL", "HOLD")
MISSING = "Missing"

RESPONSE_MAP = "map<string,string>"

# A fenced object: all up to the first brace that closes the fence, else the rest.
_OBJECT = r"(?s)```json(.*?\}(?=```)|.*)"
_AROUND = r"(?s)^(.*?)```json(?:.*?\}```|.*)(.*)$"


def json_block(raw: Column) -> Column:
    """DOM5: struct(json_text, additional, parsed) for a model response.

    Line breaks are dropped.  ``json_text`` is the content of the first JSON
    fence, ``additional`` everything around it (both NULL without a fence);
    ``parsed`` is a string map, NULL when the content is no JSON object
    (single quotes rejected, K12), in which case callers keep the raw text
    (SC27).
    """
    line = F.translate(raw, "\n", "")
    fenced = F.contains(line, F.lit(JSON_OPEN))
    content = F.when(fenced, F.regexp_extract(line, _OBJECT, 1))
    around = F.when(fenced, F.regexp_replace(line, _AROUND, "$1$2"))
    parsed = F.from_json(content, RESPONSE_MAP, {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.struct(content.alias("json_text"), around.alias("additional"), parsed.alias("parsed"))


def keyword_decision(text: Column, words=TRADE_WORDS) -> Column:
    """SC9 + DOM6 fallback: the single trade word present (case-sensitive
    substring test), else ``Missing`` when none or several appear."""
    hits = [F.when(F.instr(text, w) > 0, F.lit(w)) for w in words]
    arr = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.size(arr) == 1, F.element_at(arr, 1)).otherwise(F.lit(MISSING))


def first_key(m: Column, *keys: str) -> Column:
    """SC20: value of the first key present."""
    return F.coalesce(*[m.getItem(k) for k in keys])


def quoted_value(raw: Column, key: str) -> Column:
    """Text fallback: the quoted value after ``'key':`` or ``"key":`` (K13 fix)."""
    pat = "['\"]" + key + "['\"]\\s*:\\s*['\"]([^'\"]*)['\"]"
    return F.nullif(F.regexp_extract(raw, pat, 1), F.lit(""))


def number_value(raw: Column, key: str) -> Column:
    """Text fallback: the (optionally quoted) integer after a key (K13 fix)."""
    pat = "['\"]" + key + "['\"]\\s*:\\s*['\"]?([0-9]+)"
    return F.nullif(F.regexp_extract(raw, pat, 1), F.lit(""))
