"""Numeric helpers shared by operators and fixtures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Half-up rounding done in plain double arithmetic.

    ``floor(x * 10^d + 0.5) / 10^d`` gives the same double in every IEEE
    engine, unlike ``round``, whose tie handling differs between engines.
    """
    scale = float(10 ** digits)
    return (F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def r4(x: Column) -> Column:
    return round_half_up(x, 4)


def r6(x: Column) -> Column:
    return F.round(x, 6)
