"""Text helpers for prompt assembly (SC2, SC16-SC19, SC22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_before(text: Column, marker: str) -> Column:
    """SC16: the text before the first ``marker`` (all of it when absent)."""
    return F.substring_index(text, marker, 1)


def text_after(text: Column, marker: str) -> Column:
    """SC17: the text after the first ``marker`` (NULL when absent)."""
    pos = F.instr(text, marker)
    return F.when(pos > 0, text.substr(pos + len(marker), F.length(text)))


def fill_template(template: str, **parts: Column) -> Column:
    """SC18: replace ``{name}`` placeholders of a template with columns."""
    out = F.lit(template)
    for name, col in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col.cast("string"), F.lit("")))
    return out


def number_text(x: Column, decimals: int = 4) -> Column:
    """Fixed-point text of a double (own format, not pandas padding)."""
    return F.format_string(f"%.{decimals}f", x)


def lines_in_order(order: Column, line: Column) -> Column:
    """SC19 (aggregate): lines of a group joined by newlines in ``order``.
    Use inside ``agg``; the group is one company's statement (bounded)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))),
                                    lambda s: s["l"]), "\n")


def drop_first_line(text: Column) -> Column:
    """SC22: all lines but the first."""
    parts = F.split(text, "\n")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "\n")
