"""Date helpers (SC5-SC8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_buckets_back(as_of: Column, months: int) -> Column:
    """Array of month starts touched by ``[add_months(as_of, -months), as_of]``."""
    lo = F.trunc(F.add_months(as_of, -months), "month")
    hi = F.trunc(as_of, "month")
    return F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH"))


def quarter_end(d: Column) -> Column:
    """Calendar quarter end of a date (AGG15, ``C1231`` alignment)."""
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def fiscal_quarter_end(d: Column) -> Column:
    """The calendar quarter end a fiscal period end belongs to (AGG15).  Ends
    up to two weeks into a quarter (52-week years) belong to the one before."""
    return quarter_end(F.date_sub(d, 15))


def previous_quarter_end(d: Column) -> Column:
    return F.date_sub(F.trunc(d, "quarter"), 1)


def iso_date(d: Column) -> Column:
    """SC7: date as ``YYYY-MM-DD``."""
    return F.date_format(d, "yyyy-MM-dd")


def epoch_ms_to_timestamp(ms: Column) -> Column:
    """SC6: epoch milliseconds to timestamp."""
    return F.timestamp_millis(ms.cast("long"))
