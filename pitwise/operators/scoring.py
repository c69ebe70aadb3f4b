"""Prompt assembly and batch scoring (DOM14, U4-U8, JN15, WIN13, AGG17).

The scoring function is user supplied (a model, a remote client, ...).  It
is injected as a factory that is called once per task, and is fed batches
of prompts through ``mapInPandas`` (Arrow batches), one row out per row in,
with per-row error isolation.  Nothing passes through the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.text import fill_template, number_text
from pitwise.operators import statements as st
from pitwise.sizing import by_security

PROMPT_TEMPLATE = (
    "Company: {name}\nSector: {sector}\nDate: {date}\n"
    "Income Statement:\n{income}\nBalance Sheet:\n{balance}\nHistorical Price:\n{prices}"
)
PRICE_MONTHS = 12
STAGE_TEMPLATE = "Previous analysis:\n{previous}\n\n{prompt}"

Scorer = Callable[[list[str]], list[str]]


# ------------------------------------------------------------- prompts
def statement_line(n_periods: int = st.N_PERIODS):
    vals = [number_text(F.col(c)) for c in st.PERIOD_LABELS[:n_periods]]
    return F.concat(st.clean_label(F.col("item")), F.lit(": "), F.concat_ws(" | ", *vals))


def _with_prices(requests: DataFrame, prices: DataFrame, months: int) -> DataFrame:
    """``requests`` and, as ``__px``, the (date, px) of each one's trailing
    window in order (NULL or empty without any).

    Prices are dealt by security and packed to one row per year and security,
    with the days that requests of that year can reach (a block holds
    ``months / 12 + 1`` years); a request takes the block of its own year, so
    no row per request and day is shuffled or grouped."""
    back = -(-months // 12)
    px = by_security(prices.select("id", "date", "px")).withColumn(
        "__y", F.explode(F.sequence(F.year("date"), F.year("date") + F.lit(back))))
    blocks = px.groupBy("id", "__y").agg(F.array_sort(F.collect_list(F.struct("date", "px"))).alias("__days")).select(
        F.col("id").alias("__id"), F.make_date("__y", F.lit(1), F.lit(1)).alias("__from"),
        F.make_date("__y", F.lit(12), F.lit(31)).alias("__to"), "__days")
    inside = lambda x: (x["date"] >= F.add_months("as_of", -months)) & (x["date"] <= F.col("as_of"))
    of_year = (F.col("id") == F.col("__id")) & F.to_date("as_of").between(F.col("__from"), F.col("__to"))
    return requests.join(blocks, of_year, "left").select(*requests.columns, F.filter("__days", inside).alias("__px"))


def _price_lines(px) -> Column:
    line = lambda x: F.concat(F.date_format(x["date"], "yyyy-MM-dd"), F.lit(": "), number_text(x["px"]))
    return F.array_join(F.transform(px, line), "\n")


def price_history(requests: DataFrame, prices: DataFrame, months: int = PRICE_MONTHS) -> DataFrame:
    """M4: per ``(as_of, id)`` request, the closes of
    ``[add_months(as_of, -months), as_of]`` as text lines ``date: px``, oldest
    first (pass a filled daily series, e.g. ``forward_fill``).  Requests
    without a price in the window give no row."""
    asked = requests.select("as_of", "id").distinct()
    return _with_prices(asked, prices, months).where(F.size("__px") > 0).select("as_of", "id", _price_lines(F.col("__px")).alias("prices"))


def prompt_table(matrix: DataFrame, securities: DataFrame, template: str = PROMPT_TEMPLATE,
                 prices: DataFrame | None = None, price_months: int = PRICE_MONTHS) -> DataFrame:
    """DOM14: one prompt per (as_of, id): the cleaned statements (value
    duplicates and all-zero items removed, labels cleaned) rendered as text
    lines in item order, then the trailing price history (``prices``:
    ``(id, date, px)``; empty without it), filled into a template with the
    company metadata (empty where a company has none).  Lines are gathered per
    company and date, a bounded group."""
    m = st.drop_all_zero_items(st.dedupe_item_values(matrix)).withColumn("__line", statement_line())
    is_line = F.when(F.col("statement") == "is", F.col("__line"))
    bs_line = F.when(F.col("statement") == "bs", F.col("__line"))
    is_no = F.when(F.col("statement") == "is", F.col("item_no"))
    bs_no = F.when(F.col("statement") == "bs", F.col("item_no"))
    g = m.groupBy("as_of", "id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_line.isNotNull(), F.struct(is_no.alias("o"), is_line.alias("l"))))),
                                 lambda s: s["l"]), "\n").alias("income"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(bs_line.isNotNull(), F.struct(bs_no.alias("o"), bs_line.alias("l"))))),
                                 lambda s: s["l"]), "\n").alias("balance"),
    )
    if prices is not None:
        # looked up for the rendered rows themselves, so the matrix is computed once
        g = _with_prices(g, prices, price_months).withColumn("prices", _price_lines(F.col("__px")))
    else:
        g = g.withColumn("prices", F.lit(None).cast("string"))
    meta = securities.select("id", "name", "sector")
    j = g.join(meta, "id", "left")
    prompt = fill_template(template, name=F.col("name"), sector=F.col("sector"), date=F.date_format("as_of", "yyyy-MM-dd"),
                           income=F.col("income"), balance=F.col("balance"), prices=F.col("prices"))
    return j.select("as_of", "id", prompt.alias("prompt"))


def company_records(matrix: DataFrame, securities: DataFrame, prices: DataFrame, price_months: int = PRICE_MONTHS, eps_item: int = 47) -> DataFrame:
    """FLT13 in batch form: the whole record of every (as_of, id).  Its metadata
    (figi, name, sector; NULL where a company has none), its cleaned statements
    as text (``sec_fs``; as in prompts), its closes of the trailing
    ``price_months`` as text (``stock_price``), the number of its items and the
    EPS of ``t``.  A record stays if all its items are zero or it has no price;
    that part is empty then.  Items of equal values are grouped, not dropped
    first, so one pass over the matrix counts and renders."""
    labels = st.PERIOD_LABELS
    is_eps = (F.col("statement") == "is") & (F.col("item_no") == eps_item)
    alike = matrix.groupBy("as_of", "id", "statement", *labels).agg(
        F.min(F.struct("item_no", "item")).alias("__first"), F.count("*").alias("__n"), F.max(F.when(is_eps, F.col("t"))).alias("__eps"))
    rows = alike.select("as_of", "id", "statement", *labels, "__first.item_no", "__first.item", "__n", "__eps").withColumn(
        "__line", F.when(F.exists(F.array(*labels), lambda x: x != 0), statement_line()))

    def lines(statement):
        of = F.when((F.col("statement") == statement) & F.col("__line").isNotNull(), F.struct("item_no", "__line"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(of)), lambda x: x["__line"]), "\n")

    g = rows.groupBy("as_of", "id").agg(F.sum("__n").alias("n_items"), F.max("__eps").alias("eps_t"), lines("is").alias("__income"), lines("bs").alias("__balance"))
    g = _with_prices(g, prices, price_months)
    record = g.select("as_of", "id", "n_items", "eps_t",
                      F.concat(F.lit("Income Statement:\n"), "__income", F.lit("\nBalance Sheet:\n"), "__balance").alias("sec_fs"),
                      F.concat(F.lit("Historical Price:\n"), F.coalesce(_price_lines(F.col("__px")), F.lit(""))).alias("stock_price"))
    return st.attach_metadata(record, securities.select("id", "figi", "name", "sector")).select(
        "as_of", "id", "figi", "name", "sector", "n_items", "eps_t", "sec_fs", "stock_price")


# ------------------------------------------------------------- scoring
def length_rule_scorer() -> Scorer:
    """Deterministic stand-in scorer for tests and benchmarks: decision and
    confidence follow the prompt length; prompts whose length is a multiple
    of 17 fail, to exercise row error isolation."""

    words = ("BUY", "SELL", "HOLD")

    def score(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            n = len(p)
            if n % 17 == 0:
                raise ValueError(f"scorer failed on a prompt of length {n}")
            out.append('```json\n{"decision": "%s", "confidence": %d}```' % (words[n % 3], n % 10))
        return out

    return score


def batch_score(
    df: DataFrame,
    scorer_factory: Callable[[], Scorer],
    *,
    keys: list[str],
    prompt_col: str = "prompt",
    batch_size: int = 16,
    n_partitions: int | None = None,
    max_requests_per_s: float | None = None,
    response_col: str = "response_raw",
    error_col: str = "error",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """U4/U5/U6/U7: score every row with a user scorer inside the tasks.

    The scorer is built once per task; prompts go to it in batches of
    ``batch_size``; a failing batch is retried row by row so one bad record
    only fills its own ``error`` column.  ``n_partitions`` spreads the rows
    over that many tasks (the fan-out), and ``max_requests_per_s`` is a
    per-task pace (divide the global cap by the number of tasks).  ``carry``
    columns pass through unchanged, so chained stages need no join back."""
    src = df.select(*keys, *carry, prompt_col)
    if n_partitions:
        src = src.repartition(n_partitions, *keys)
    passed = list(keys) + list(carry)
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in passed)
    schema = f"{key_fields}, `{response_col}` string, `{error_col}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        gap = 1.0 / max_requests_per_s if max_requests_per_s else 0.0
        last = 0.0
        for pdf in batches:
            prompts = pdf[prompt_col].fillna("").astype(str).tolist()
            responses: list[str | None] = []
            errors: list[str | None] = []
            for i in range(0, len(prompts), batch_size):
                chunk = prompts[i:i + batch_size]
                if gap:
                    wait = last + gap * len(chunk) - time.monotonic()
                    if wait > 0:
                        time.sleep(wait)
                    last = time.monotonic()
                try:
                    res = list(scorer(chunk))
                    if len(res) != len(chunk):
                        raise ValueError("scorer returned a different number of responses")
                    responses += res
                    errors += [None] * len(chunk)
                except Exception:  # noqa: BLE001 - isolate rows
                    for p in chunk:
                        try:
                            responses.append(scorer([p])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            responses.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
            out = pdf[passed].copy()
            out[response_col] = responses
            out[error_col] = errors
            yield out

    return src.mapInPandas(run, schema)


def staged_score(
    df: DataFrame,
    scorer_factory: Callable[[], Scorer],
    *,
    keys: list[str],
    stages: int = 2,
    template: str = STAGE_TEMPLATE,
    **kw,
) -> DataFrame:
    """U8: each stage's prompt embeds the previous stage's response.

    A linear chain of ``mapInPandas`` passes: earlier responses ride along as
    pass-through columns, so no stage output feeds two branches and the
    scorer runs exactly once per row and stage."""
    cur = df.select(*keys, F.col("prompt").alias("__base"), F.col("prompt"))
    carried: list[str] = ["__base"]
    for s in range(1, stages + 1):
        resp, err = f"response_{s}", f"error_{s}"
        scored = batch_score(cur, scorer_factory, keys=keys, carry=tuple(carried), response_col=resp,
                             error_col=err, **kw)
        carried += [resp, err]
        cur = scored.withColumn("prompt", fill_template(template, previous=F.col(resp), prompt=F.col("__base")))
    return cur.select(*keys, *[c for c in carried if c != "__base"])


# ---------------------------------------------------- run bookkeeping
def resume_todo(todo: DataFrame, done: DataFrame, keys=("date", "security")) -> DataFrame:
    """JN15: records not scored yet (anti join replaces a positional resume)."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def chunk_assign(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """WIN13: a dense 0-based ``ordinal`` in the given order, and its ``chunk``.

    The ordinal is the number of rows of earlier days (first column of the
    order), plus those of earlier securities on the day (second column), plus
    the row's place among its own.  The counts are combined before the
    shuffle; the running sums are over days and over a day's securities, and
    the row numbers over one security's rows of one day.  Nothing depends on
    partitions.  Rows equal in the whole order are numbered in any order."""
    day, security, *rest = order
    per = df.groupBy(F.col(day).alias("__d"), F.col(security).alias("__s")).agg(F.count("*").alias("__n"))
    days = per.groupBy("__d").agg(F.sum("__n").alias("__n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    start = days.select(F.col("__d").alias("__day"), F.coalesce(F.sum("__n").over(before.orderBy("__d")), F.lit(0)).alias("__start"))
    within = per.select("__d", "__s", F.coalesce(F.sum("__n").over(before.partitionBy("__d").orderBy("__s")), F.lit(0)).alias("__skip"))
    offsets = within.join(start, F.col("__d").eqNullSafe(F.col("__day"))).select("__d", "__s", (F.col("__start") + F.col("__skip")).alias("__from"))
    place = F.row_number().over(Window.partitionBy(day, security).orderBy(*(rest or [F.lit(0)]))) - 1
    same = F.col(day).eqNullSafe(F.col("__d")) & F.col(security).eqNullSafe(F.col("__s"))
    numbered = df.withColumn("__place", place).join(offsets, same)
    ordinal = (F.col("__from") + F.col("__place")).cast("long")
    return numbered.select(*df.columns, ordinal.alias("ordinal"), F.floor(ordinal / size).cast("long").alias("chunk"))


def throughput(metrics: DataFrame) -> DataFrame:
    """AGG17: total tokens over the elapsed wall time across workers."""
    elapsed = F.unix_timestamp(F.max("end_ts")) - F.unix_timestamp(F.min("start_ts"))
    return metrics.agg(
        F.countDistinct("worker").alias("n_workers"), F.sum("n_tokens").alias("total_tokens"),
        elapsed.alias("elapsed_s"), F.try_divide(F.sum("n_tokens"), elapsed).alias("tokens_per_s"),
    )
