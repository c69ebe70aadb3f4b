"""As-of join: the last observation on or before a time, per key.

Facts or probes of a hot key never meet in one window.  Observations are
reduced to one per (key, time) by a grouped maximum, probes to their distinct
(key, time) instants; both are partial aggregates, and only these go through
the ordered pass.  The probes then take their instant's answer by an equi-join
on (key, time), which Spark splits where one key is hot.

Times finer than days are cut into slices (``slice_of``, months by default):
the ordered pass then runs per (key, slice), and each slice starts from the
last observation of the slices before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], *,
              version: Sequence[str] = (), greatest: bool = False, slice_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """All rows and columns of ``left``, and the ``values`` of the last row of
    ``right`` with equal ``by`` and ``right_time <= left_time`` (NULL without
    one).  Of rows of one time the greatest ``version`` counts, then the
    greatest values.  ``greatest``: the greatest values of all rows so far
    instead of the last ones.  Rows of ``right`` without key or time are left
    out; rows of ``left`` without key or time stay, with NULL values; rows that
    repeat stay as often as they are there."""
    by, values, version = list(by), list(values), list(version)
    if clash := set(values) & set(left.columns):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    lt = left.schema[left_time].dataType
    if slice_of is None and not isinstance(lt, T.DateType):
        slice_of = lambda t: F.trunc(t, "month")
    known = right.where(F.col(right_time).isNotNull())
    for k in by:
        known = known.where(F.col(k).isNotNull())
    rank = [] if greatest else [F.col(right_time).cast(lt).alias("__at"), *(F.col(c).alias(f"__v{i}") for i, c in enumerate(version))]
    seen = known.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), F.col(right_time).cast(lt).alias("__t")).agg(
        F.max(F.struct(*rank, *(F.col(c).alias(f"__x{i}") for i, c in enumerate(values)))).alias("__o"))
    keys = [f"__k{i}" for i in range(len(by))]
    asked = left.select(*(F.col(k).alias(a) for k, a in zip(by, keys, strict=True)), F.col(left_time).alias("__t")).distinct()
    for k in [*keys, "__t"]:
        asked = asked.where(F.col(k).isNotNull())
    both = seen.withColumn("__probe", F.lit(0)).unionByName(asked.withColumn("__probe", F.lit(1)), allowMissingColumns=True)
    if slice_of is None:
        w = Window.partitionBy(*keys).orderBy("__t", "__probe").rowsBetween(Window.unboundedPreceding, 0)
        answer = both.withColumn("__o", F.max("__o").over(w))
    else:
        both = both.withColumn("__s", slice_of(F.col("__t")))
        before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        carried = both.groupBy(*keys, "__s").agg(F.max("__o").alias("__m")).withColumn("__c", F.max("__m").over(before)).drop("__m")
        w = Window.partitionBy(*keys, "__s").orderBy("__t", "__probe").rowsBetween(Window.unboundedPreceding, 0)
        # an observation of this slice is later than any carried one
        now = both.withColumn("__o", F.max("__o").over(w)).where("__probe = 1").join(carried, [*keys, "__s"])
        answer = now.withColumn("__o", F.greatest("__o", "__c") if greatest else F.coalesce("__o", "__c"))
    answer = answer.where("__probe = 1").select(*keys, "__t", *(F.col(f"__o.__x{i}").alias(f"__x{i}") for i in range(len(values))))
    cond = left[left_time] == answer["__t"]
    for k, a in zip(by, keys, strict=True):
        cond = cond & (left[k] == answer[a])
    return left.join(answer, cond, "left").select(*(left[c] for c in left.columns), *(F.col(f"__x{i}").alias(c) for i, c in enumerate(values)))
