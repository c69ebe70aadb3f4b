"""Point-in-time statement operators.

Long facts ``(id, statement, item_no, item, period_end, publish_date, value)``
are the storage form.  Requests ``(as_of, id)`` select, per relative
period, the latest vintage published on or before ``as_of`` (JN8); the
statement matrix pivots the six most recent periods of a batch into
columns ``t, t_1 .. t_5`` (AGG10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.dates import fiscal_quarter_end
from pitwise.operators.asof import asof_join
from pitwise.sizing import broadcast_bounded, by_security

N_PERIODS = 6
PERIOD_LABELS = ["t"] + [f"t_{i}" for i in range(1, N_PERIODS)]


def latest_available_period(requests: DataFrame, vintages: DataFrame) -> DataFrame:
    """Per ``(as_of, id)`` request: the newest period end whose first vintage
    was published on or before ``as_of`` (NULL before the first report).

    An as-of lookup (``asof_join``) of the greatest period so far among the
    periods' first publications; ``publish_date <= as_of`` is inclusive.  Its
    ordered pass holds one security's request days and period ends, which the
    calendar bounds, never the number of facts or vintages."""
    first = vintages.groupBy("id", "period_end").agg(F.min("publish_date").alias("first_published")).select(
        "id", "first_published", F.col("period_end").alias("latest"))
    return asof_join(requests.select("as_of", "id"), first, ["id"], "as_of", "first_published", ["latest"], greatest=True)


def candidate_periods(requests: DataFrame, vintages: DataFrame, n: int = N_PERIODS) -> DataFrame:
    """The ``n`` relative periods a request asks for (offsets ``-(n-1)Q .. 0Q``),
    as their bounds: ``newest``, the security's latest published period end,
    and ``oldest``, the quarter end ``n - 1`` quarters before it
    (calendar-year aligned, AGG15; period ends are quarter ends, so those
    between the two are the candidates).  A quarter the security never
    reported has no facts, so it pads to 0 in the matrix (K2).  One row per
    request that has a published period."""
    latest = latest_available_period(requests, vintages).where(F.col("latest").isNotNull())
    return latest.select("as_of", "id", F.last_day(F.add_months("latest", -3 * (n - 1))).alias("oldest"), F.col("latest").alias("newest"))


def pit_asof(requests: DataFrame, vintages: DataFrame, n_periods: int = N_PERIODS) -> DataFrame:
    """JN8: per request, per statement item and relative period, the latest
    vintage with ``publish_date <= as_of``.  Each vintage holds from its
    publication until the item's next one, so ``publish_date <= as_of < next``
    picks at most one per request, item and period: no look-ahead, no grouping
    of the joined rows.  Period ends are aligned to calendar quarters first, so
    filers with other fiscal days keep their facts; of two vintages of one day
    the greater value counts (the others are replaced on their own day).

    Vintages and requests are dealt by security and joined on it alone, with
    the bounds of the periods as a condition: a security's request days and
    periods are bounded by the calendar.  The result stays dealt by security,
    so what groups by (as_of, id, ...) needs no shuffle of the joined facts,
    which are many times the vintages.  The side of the requests fixes the
    number of tasks (see ``by_security``)."""
    v = vintages.select("id", "statement", "item_no", "item", fiscal_quarter_end(F.col("period_end")).alias("period_end"),
                        "publish_date", "value")
    req = by_security(candidate_periods(requests.select("as_of", "id").distinct(), v, n_periods))
    # ``item`` is a label of (statement, item_no), so it rides along as a key
    w = Window.partitionBy("id", "period_end", "statement", "item_no", "item").orderBy("publish_date", "value")
    held = v.where(F.col("publish_date").isNotNull()).repartition("id").withColumn("__next", F.lead("publish_date").over(w))
    j = req.join(held, "id").where(
        F.col("period_end").between(F.col("oldest"), F.col("newest"))
        & (F.col("publish_date") <= F.col("as_of")) & (F.col("__next").isNull() | (F.col("__next") > F.col("as_of"))))
    return j.select("as_of", "id", "statement", "item_no", "item", "period_end", "publish_date", "value")


def ranked_periods(pit_long: DataFrame, n_periods: int = N_PERIODS) -> DataFrame:
    """FLT6 + FLT9 + WIN4: periods that carry a non-zero value somewhere in the
    batch (same as_of), ranked newest first within the batch, top ``n``.
    Computed on the small (as_of, period_end) table, not on the facts."""
    p = pit_long.where(F.col("period_end").isNotNull()).groupBy("as_of", "period_end").agg(
        F.max(F.abs("value")).alias("__m")).where(F.col("__m") > 0)
    w = Window.partitionBy("as_of").orderBy(F.col("period_end").desc())
    return p.select("as_of", "period_end", F.dense_rank().over(w).alias("period_rank")).where(
        F.col("period_rank") <= n_periods)


def periods_per_date(pit_long: DataFrame, n_periods: int = N_PERIODS) -> DataFrame:
    """K2: how many real periods each batch's matrix holds (``n_periods`` at
    most; fewer means the remaining columns are zero padding)."""
    return ranked_periods(pit_long, n_periods).groupBy("as_of").agg(F.count("*").alias("n_periods"))


def relative_periods(pit_long: DataFrame, n_periods: int = N_PERIODS) -> DataFrame:
    """Long facts with ``period_rank`` (1 = t) and ``period_label``."""
    r = ranked_periods(pit_long, n_periods)
    j = pit_long.join(broadcast_bounded(r), ["as_of", "period_end"])  # <= 6 rows per date
    label = F.when(F.col("period_rank") == 1, F.lit("t")).otherwise(
        F.concat(F.lit("t_"), (F.col("period_rank") - 1).cast("string")))
    return j.withColumn("period_label", label)


def statement_matrix(pit_long: DataFrame, n_periods: int = N_PERIODS) -> DataFrame:
    """AGG10: one row per (as_of, id, statement, item) with columns
    ``t .. t_{n-1}``, missing periods filled with 0 (K2: short histories are
    padded, not dropped; K20: zero fill merges missing and zero).

    The batch-level period ranks (FLT9 + WIN4) come from a partial aggregate
    per (as_of, period_end) and are broadcast back (bounded: at most ``n`` rows
    per date); the pivot is a conditional aggregate with fixed-width buffers
    (no per-group arrays).  Rows that ``pit_asof`` dealt by security are
    pivoted where they are; both branches read its two exchanges, so the facts
    themselves are never shuffled.  Other rows are combined before Spark deals
    them by the keys."""
    keys = ["as_of", "id", "statement", "item_no", "item"]
    facts = pit_long.where(F.col("period_end").isNotNull()).select(*keys, "period_end", "value")
    per = facts.groupBy("as_of", "period_end").agg(F.max(F.abs("value")).alias("__m")).where(F.col("__m") > 0)
    w = Window.partitionBy("as_of").orderBy(F.col("period_end").desc())
    ranked = per.select("as_of", "period_end", F.dense_rank().over(w).alias("__r")).where(F.col("__r") <= n_periods)
    j = facts.join(broadcast_bounded(ranked), ["as_of", "period_end"])
    labels = PERIOD_LABELS[:n_periods]
    g = j.groupBy(*keys).agg(*[F.max(F.when(F.col("__r") == i + 1, F.col("value"))).alias(lab)
                               for i, lab in enumerate(labels)])
    return g.select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in labels])


def _values(n_periods: int = N_PERIODS):
    return [F.col(c) for c in PERIOD_LABELS[:n_periods]]


def drop_all_zero_items(matrix: DataFrame, n_periods: int = N_PERIODS) -> DataFrame:
    """FLT7: drop line items that are zero in every period."""
    return matrix.where(F.exists(F.array(*_values(n_periods)), lambda x: x != 0))


def keep_any_positive(matrix: DataFrame, n_periods: int = N_PERIODS) -> DataFrame:
    """FLT8: keep line items with at least one positive value."""
    return matrix.where(F.exists(F.array(*_values(n_periods)), lambda x: x > 0))


def dedupe_item_values(matrix: DataFrame, n_periods: int = N_PERIODS) -> DataFrame:
    """WIN6: drop a line item whose values equal an earlier item's in the same
    statement (label ignored, K5; the lowest item number is kept)."""
    from pitwise.operators.news import first_per_key

    keys = ["as_of", "id", "statement"] + PERIOD_LABELS[:n_periods]
    return first_per_key(matrix, keys, ["item_no"])


def clean_label(item) -> "F.Column":
    """SC2: drop the ``NN `` prefix and the `` (Adj)`` suffix."""
    return F.replace(F.substring(item, 4, 1 << 20), F.lit(" (Adj)"), F.lit(""))


def statement_long(matrix: DataFrame, n_periods: int = N_PERIODS) -> DataFrame:
    """AGG11: matrix back to long rows (as_of, id, statement, item_no, period_label, value)."""
    labels = PERIOD_LABELS[:n_periods]
    return matrix.unpivot(["as_of", "id", "statement", "item_no", "item"], labels, "period_label", "value")


def field_per_date(matrix: DataFrame, item_no: int, statement: str = "is") -> DataFrame:
    """DOM2: value of one line item at ``t`` per (security, date)."""
    return matrix.where((F.col("item_no") == item_no) & (F.col("statement") == statement)).select(
        F.col("id").alias("security"), F.col("as_of").alias("date"), F.col("t").alias("value"))


def latest_revision(vintages: DataFrame) -> DataFrame:
    """JN10: the revision date of the latest period (latest revision on ties) per id."""
    g = vintages.groupBy("id").agg(F.max(F.struct("period_end", "revision_date")).alias("__r"))
    return g.select("id", F.col("__r.revision_date").alias("revision_date"))


def attach_revision_date(calendar: DataFrame, vintages: DataFrame) -> DataFrame:
    return calendar.join(latest_revision(vintages), "id", "left")


def attach_metadata(df: DataFrame, securities: DataFrame, key: str = "id") -> DataFrame:
    """JN3: attach name / figi / sector (the planner broadcasts the dimension
    only under its size threshold).  Rows without metadata stay, with NULLs;
    ``unmatched_keys`` lists them."""
    return df.join(securities, key, "left")


def unmatched_keys(df: DataFrame, securities: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``df`` without metadata (the reference raises on these)."""
    return df.join(securities.select(key), key, "left_anti")


def ltm(facts: DataFrame, flow_statements=("is",), quarters: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """AGG14: last-twelve-months value.  Flow items: the sum of the last four
    quarters when all four consecutive quarters exist (else NULL); balance
    items: the latest value.  ``by`` names further keys of a series, as
    ``("as_of",)`` for point-in-time rows.  Windows are per (by, id, item),
    bounded by that item's history length."""
    w = Window.partitionBy(*by, "id", "statement", "item_no").orderBy("period_end").rowsBetween(-(quarters - 1), 0)
    s = F.sum("value").over(w)
    n = F.count("value").over(w)
    first = F.min("period_end").over(w)
    contiguous = (n == quarters) & (F.months_between("period_end", first) == 3 * (quarters - 1))
    is_flow = F.col("statement").isin(list(flow_statements))
    return facts.select(
        *by, "id", "statement", "item_no", "period_end",
        F.when(is_flow, F.when(contiguous, s)).otherwise(F.col("value")).alias("ltm_value"),
    )


def fx_convert(facts: DataFrame, fx: DataFrame, ccy: DataFrame, share_items=(44,), version=()) -> DataFrame:
    """JN17: convert monetary items with the last rate of the fact's currency
    group on or before its period end; share counts are exempt.  Facts without
    such a rate (or without a currency group) stay, with a NULL rate and, but
    for share counts, a NULL value.  Of several rates of a group on one day the
    greatest ``version`` counts, then the greatest rate."""
    j = asof_join(facts.join(ccy, "id", "left"), fx, ["ccy_group"], "period_end", "rate_date", ["rate"], version=version)
    conv = F.when(F.col("item_no").isin(list(share_items)), F.col("value")).otherwise(F.col("value") * F.col("rate"))
    return j.select("id", "statement", "item_no", "period_end", F.col("value").alias("value_local"), "rate", conv.alias("value"))


# ------------------------------------------------------- nested PIT store
_ITEM_MAP = "map<string,map<string,double>>"


def pit_nest(matrix: DataFrame) -> DataFrame:
    """AGG12: one row per (as_of, id) with ``is`` / ``bs`` JSON objects
    ``{period_label: {item: value}}`` like the reference's store.  Grouping is
    per (as_of, id), once, over the matrix rows: each list holds one company's
    items on one date, and the periods are spread within it."""
    def rows(statement):
        return F.collect_list(F.when(F.col("statement") == statement, F.struct("item_no", "item", *PERIOD_LABELS)))

    def items(c, label):
        return F.map_from_entries(F.transform(c, lambda x: F.struct(x["item"], x[label])))

    def text(c):
        periods = F.map_from_arrays(F.array(*[F.lit(x) for x in PERIOD_LABELS]), F.array(*[items(c, x) for x in PERIOD_LABELS]))
        return F.when(F.size(c) > 0, F.to_json(periods))

    nested = matrix.groupBy("as_of", "id").agg(F.array_sort(rows("is")).alias("__is"), F.array_sort(rows("bs")).alias("__bs"))
    return nested.select("as_of", "id", text(F.col("__is")).alias("is_json"), text(F.col("__bs")).alias("bs_json"))


def pit_explode(nested: DataFrame) -> DataFrame:
    """SRC2: nested store rows back to long facts
    (as_of, id, statement, period_label, item, value)."""
    parts = nested.select("as_of", "id", F.explode(F.map_from_arrays(
        F.array(F.lit("is"), F.lit("bs")), F.array("is_json", "bs_json"))).alias("statement", "__json"))
    parsed = parts.where(F.col("__json").isNotNull()).select(
        "as_of", "id", "statement", F.explode(F.from_json("__json", _ITEM_MAP)).alias("period_label", "__items"))
    return parsed.select("as_of", "id", "statement", "period_label",
                         F.explode("__items").alias("item", "value"))
