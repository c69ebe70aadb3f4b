"""DOM1 change classifier and the EPS direction rules (SC13, SC21, K4, K14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Direction words and magnitude bands of the reference.
INCREASING = "INCREASING"
DECREASING = "DECREASING"
FLAT, SMALL, LARGE, VERY_LARGE = "FLAT", "SMALL", "LARGE", "VERY LARGE"
FLAT_BELOW = 0.02
SMALL_UP_TO = 0.05
LARGE_UP_TO = 0.1


def interpret_change(eps_t: Column, eps_t1: Column, signed: bool = False) -> Column:
    """struct(direction, band, magnitude) for a move from ``eps_t`` to ``eps_t1``.

    Both zero: INCREASING/FLAT/0.  Prior zero: INCREASING/LARGE/next.  Next
    zero: DECREASING/LARGE/prior.  Else ``m = next/prior - 1`` (``signed``:
    ``(next - prior)/|prior|``, fixing the inverted direction for a negative
    prior, K4), INCREASING iff m > 0, band by |m|.
    """
    if signed:
        m = F.try_divide(eps_t1 - eps_t, F.abs(eps_t))
    else:
        m = F.try_divide(eps_t1, eps_t) - 1
    am = F.abs(m)
    band = F.when(am < FLAT_BELOW, FLAT).when(am <= SMALL_UP_TO, SMALL).when(am <= LARGE_UP_TO, LARGE).otherwise(VERY_LARGE)
    both0 = (eps_t == 0) & (eps_t1 == 0)
    direction = (
        F.when(both0, INCREASING).when(eps_t == 0, INCREASING).when(eps_t1 == 0, DECREASING)
        .when(m > 0, INCREASING).otherwise(DECREASING)
    )
    band = F.when(both0, FLAT).when((eps_t == 0) | (eps_t1 == 0), LARGE).otherwise(band)
    magnitude = (
        F.when(both0, F.lit(0.0)).when(eps_t == 0, eps_t1).when(eps_t1 == 0, eps_t).otherwise(m)
    ).cast("double")
    return F.struct(direction.alias("direction"), band.alias("band"), magnitude.alias("magnitude"))


def direction_word(x: Column) -> Column:
    """K14: one rule for a free-text direction: INCREASE/INCREASING (any case,
    trimmed) is INCREASING, everything else DECREASING."""
    u = F.upper(F.trim(x))
    return F.when(u.isin("INCREASE", "INCREASING"), INCREASING).otherwise(DECREASING)
