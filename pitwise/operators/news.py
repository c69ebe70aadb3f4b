"""Headline operators: filter, two-step de-duplication, clean, trailing
news window and a seeded per-request sample.

Columns are passed by name so any headline table fits; the defaults are the
library's canonical headline schema (``suid, headline, arrival, figi, wire,
language``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.functions.dates import month_buckets_back

# The headline filter of the reference.
HEADLINE_WIRES = ("BN", "BFW")
HEADLINE_LANGUAGE = "ENGLISH"
HEADLINE_MIN_LENGTH = 25  # strictly longer than this
NEWS_WINDOW_MONTHS = 3
NEWS_SAMPLE_SIZE = 50


def _ensure_timestamp(df: DataFrame, col: str) -> DataFrame:
    if dict(df.dtypes)[col] == "string":
        return df.withColumn(col, F.try_to_timestamp(F.col(col)))
    return df


def filter_headlines(
    df: DataFrame,
    members: DataFrame | None,
    start,
    *,
    wires=HEADLINE_WIRES,
    language: str = HEADLINE_LANGUAGE,
    min_length: int = HEADLINE_MIN_LENGTH,
    id_col: str = "figi",
    member_col: str = "figi",
) -> DataFrame:
    """FLT1/FLT2: wire, language, length and start-time filter plus a
    semi join on the index universe (broadcast by the planner only under its size threshold)."""
    df = _ensure_timestamp(df, "arrival")
    out = df.where(
        F.col("wire").isin(list(wires))
        & (F.col("language") == language)
        & (F.length("headline") > min_length)
        & (F.col("arrival") >= F.lit(start).cast(dict(df.dtypes)["arrival"]))
    )
    if members is not None:
        keys = members.select(F.col(member_col).alias(id_col)).distinct()
        out = out.join(keys, id_col, "left_semi")
    return out


def first_per_key(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """Keep the first row per key by ``order`` (remaining columns break ties).

    Written as ``min(struct(order..., rest...))`` so the choice is a
    partial aggregation: a hot key is reduced map-side before the shuffle
    instead of being gathered into one window partition.
    """
    key_names = []
    key_cols = []
    for i, k in enumerate(keys):
        if isinstance(k, str):
            key_names.append(k)
            key_cols.append(F.col(k))
        else:
            name = f"__k{i}"
            key_names.append(name)
            key_cols.append(k.alias(name))
    rest = [c for c in df.columns if c not in order and c not in key_names]
    ordered = order + rest
    packed = F.struct(*[F.col(c) for c in ordered])
    agg = df.groupBy(*key_cols).agg(F.min(packed).alias("__first"))
    return agg.select(*[F.col(c) if c in key_names else F.col(f"__first.{c}").alias(c) for c in df.columns])


def dedupe_by_story(df: DataFrame) -> DataFrame:
    """WIN1: the first arrival per story id."""
    return first_per_key(df, ["suid"], ["arrival"])


def dedupe_by_day_headline(df: DataFrame) -> DataFrame:
    """WIN2: the first arrival per (calendar day, headline text)."""
    return first_per_key(df, [F.to_date("arrival"), "headline"], ["arrival", "suid"])


def clean_headlines(df: DataFrame, sort: bool = True) -> DataFrame:
    """FLT3/SRT1: four columns, lower-cased text, ordered by arrival (distributed sort)."""
    out = df.select("suid", F.lower("headline").alias("headline"), "arrival", "figi")
    return out.orderBy("arrival", "suid") if sort else out


def build_news_dataset(raw: DataFrame, members: DataFrame | None, start, sort: bool = True) -> DataFrame:
    """DOM16: filter, de-duplicate by story then by (day, text), clean."""
    return clean_headlines(dedupe_by_day_headline(dedupe_by_story(filter_headlines(raw, members, start))), sort=sort)


def news_window(
    requests: DataFrame,
    news: DataFrame,
    *,
    months: int = NEWS_WINDOW_MONTHS,
    req_id: str = "figi",
    req_date: str = "as_of",
    news_id: str = "figi",
) -> DataFrame:
    """JN6: headlines of the request's security with
    ``add_months(as_of, -months) <= arrival < as_of`` (half-open, K16).

    A range join written as an equi-join: each request is exploded into the
    calendar months its window touches (at most ``months + 1``), headlines
    carry their arrival month, the join is on (security, month) and the
    exact range is checked afterwards.  A popular security is spread over
    many (security, month) keys, so AQE can split skewed keys further.

    FLT11: a request without a date gets all headlines of its security, by an
    equi-join on the security.
    """
    undated = requests.where(F.col(req_date).isNull())
    keep = [c for c in requests.columns if c not in (req_id, req_date)]
    more = [c for c in news.columns if c != news_id and c not in keep]
    every = undated.alias("r").join(news.alias("n"), F.col(f"r.{req_id}") == F.col(f"n.{news_id}")).select(
        F.col(f"r.{req_id}").alias(req_id), F.col(f"r.{req_date}").cast("date").alias(req_date), *[F.col(f"r.{c}") for c in keep], *[F.col(f"n.{c}") for c in more])
    requests = requests.where(F.col(req_date).isNotNull())
    req = requests.select(F.col(req_id).alias("__rid"), F.col(req_date).cast("date").alias("__asof"), *[
        F.col(c) for c in requests.columns if c not in (req_id, req_date)
    ]).withColumn("__lo", F.add_months("__asof", -months))
    req = req.withColumn("__month", F.explode(month_buckets_back(F.col("__asof"), months)))
    nw = news.withColumn("__month", F.trunc(F.to_date("arrival"), "month"))
    cond = (
        (req["__rid"] == nw[news_id])
        & (req["__month"] == nw["__month"])
        & (nw["arrival"] >= req["__lo"].cast(dict(nw.dtypes)["arrival"]))
        & (nw["arrival"] < req["__asof"].cast(dict(nw.dtypes)["arrival"]))
    )
    j = req.join(nw, cond, "inner")
    keep_req = [c for c in req.columns if not c.startswith("__")]
    keep_news = [c for c in news.columns if c != news_id and c not in keep_req]
    return j.select(
        F.col("__rid").alias(req_id), F.col("__asof").alias(req_date), *[req[c] for c in keep_req], *[nw[c] for c in keep_news]
    ).unionByName(every)


def sample_news(window: DataFrame, *, n: int = NEWS_SAMPLE_SIZE, seed: str = "0", keys=("figi", "as_of")) -> DataFrame:
    """SRT6: all headlines of a request when fewer than ``n``, else ``n`` chosen by
    a seeded hash order (K17: the reference's sample is unseeded).

    ``row_number() <= n`` lets Catalyst insert a partial window-group limit
    before the shuffle, so no request sends more than ``n`` rows per task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(_sample_order(seed), F.col("suid"))
    return window.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def _sample_order(seed: str):
    return F.md5(F.concat(F.col("suid"), F.lit("|"), F.lit(seed)))


def top_per_day(news: DataFrame, *, n: int = NEWS_SAMPLE_SIZE, seed: str = "0", news_id: str = "figi") -> DataFrame:
    """The first ``n`` headlines of each (security, calendar day) in the
    sample's seeded hash order (a per-task partial limit runs before the
    shuffle, so a hot security sends at most ``n`` rows per day and task)."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.col(news_id), F.to_date("arrival")).orderBy(_sample_order(seed), F.col("suid"))
    return news.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def sample_news_window(requests: DataFrame, news: DataFrame, *, n: int = NEWS_SAMPLE_SIZE, seed: str = "0",
                       months: int = NEWS_WINDOW_MONTHS, req_id: str = "figi", req_date: str = "as_of",
                       news_id: str = "figi") -> DataFrame:
    """JN6 + SRT6 for large inputs: the same rows as
    ``sample_news(news_window(requests, news))``, computed without carrying
    every headline of a popular security into the range join.

    A request's window ``[add_months(as_of, -months), as_of)`` is a union of
    whole days and the sample order is a hash of the story id, independent of
    the request; so the first ``n`` of a window are among the first ``n`` of
    each of its days.  Headlines are cut to that per (security, day) first,
    which bounds the join input of a hot security by ``n`` per day.  A request
    without a date (FLT11) samples all headlines of its security: the first
    ``n`` of each security, cut per task before the shuffle."""
    dated, undated = requests.where(F.col(req_date).isNotNull()), requests.where(F.col(req_date).isNull())
    pre = top_per_day(news, n=n, seed=seed, news_id=news_id)
    w = news_window(dated, pre, months=months, req_id=req_id, req_date=req_date, news_id=news_id)
    w = w.unionByName(news_window(undated, sample_news(news, n=n, seed=seed, keys=(news_id,)), months=months, req_id=req_id, req_date=req_date, news_id=news_id))
    return sample_news(w, n=n, seed=seed, keys=(req_id, req_date))


def company_context(snapshot: DataFrame, sampled_news: DataFrame, keys=("figi", "as_of")) -> DataFrame:
    """DOM18: one row per (security, date) with its record and up to 50 recent
    headlines, newest first (bounded list: at most ``n`` per request)."""
    heads = sampled_news.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("arrival"), F.col("suid"), F.col("headline"))), asc=False).alias("__h"),
        F.count("*").alias("n_headlines"),
    ).select(*keys, F.col("__h.headline").alias("headlines"), "n_headlines")
    return snapshot.join(heads, list(keys), "left").withColumn("n_headlines", F.coalesce("n_headlines", F.lit(0)))
