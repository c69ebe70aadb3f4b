"""Bindings of the driver's test tables to the library's input tables.

Every view reads whole tables and derives its rows with Spark; nothing is
sampled or capped, so the work of every query grows with the scale
factor.  Securities are formed by integer division of a key
(``c_custkey div 25``; ``user_id * 2 div 5`` for the event stream) so the
number of securities grows with the data as well.  ``plans/oracle_views.py``
holds the same derivations in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.functions.dates import quarter_end
from pitwise.functions.numeric import r4

# Line-item labels of the reference's statement catalogue
# used by the fixture (statement, item number, label).
IS_REVENUE = ("is", 1, "01 Revenue (Adj)")
IS_GROSS = ("is", 8, "08 Gross Profit (Adj)")
IS_FX = ("is", 19, "19 Foreign Exch Losses (Gains) (Adj)")
IS_PRETAX_ADJ = ("is", 21, "21 Pretax Income (Loss), Adjusted (Adj)")
IS_PRETAX = ("is", 28, "28 Pretax Income (Loss), GAAP")
IS_SHARES = ("is", 44, "44 Basic Weighted Average Number of Shares")
IS_EPS_XO = ("is", 46, "46 Basic EPS from Continuing Operations")
IS_EPS = ("is", 47, "47 Basic EPS from Continuing Operations")
BS_CASH_STI = ("bs", 1, "01 Cash, Cash Equivalents & STI")
BS_CASH = ("bs", 2, "02 Cash & Cash Equivalents")

EPS_ITEM_NO = 47
SHARE_ITEMS = (44,)
CUSTOMERS_PER_SECURITY = 25


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; its schema is inferred once per path and then
    passed to later reads, which skips Spark's schema-inference job."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = _SCHEMAS.get(path)
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    if schema is None:
        _SCHEMAS[path] = df.schema
    return df


def sec_id(k: Column, suffix: str = " UN Equity") -> Column:
    return F.concat(F.lit("T"), k.cast("string"), F.lit(suffix))


def both_listings() -> Column:
    """A company has two listings (UN, UW) with the same statements."""
    return F.explode(F.array(F.lit("UN"), F.lit("UW")))


def listing_id() -> Column:
    return F.concat(F.lit("T"), F.col("k").cast("string"), F.lit(" "), F.col("listing"), F.lit(" Equity"))


def figi_of(k: Column) -> Column:
    return F.concat(F.lit("F"), k.cast("string"))


def cust_key(col: str) -> Column:
    return F.expr(f"{col} div {CUSTOMERS_PER_SECURITY}")


def user_key(col: str = "user_id") -> Column:
    return F.expr(f"({col} * 2) div 5")


# ---------------------------------------------------------------- news
def v_headlines(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select(
        F.concat(F.lit("S"), F.expr("event_id div 3").cast("string")).alias("suid"),
        F.concat(F.upper("event_type"), F.lit(" Report For Company "), (F.col("user_id") % 10).cast("string")).alias("headline"),
        F.col("ts").alias("arrival"),
        figi_of(user_key()).alias("figi"),
        F.element_at(F.array(*[F.lit(w) for w in ("BN", "BFW", "BN", "XYZ")]), (F.col("event_id") % 4 + 1).cast("int")).alias("wire"),
        F.when(F.col("event_id") % 10 == 0, "FRENCH").otherwise("ENGLISH").alias("language"),
    )


# ---------------------------------------------------------- securities
def v_securities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return (
        c.groupBy(cust_key("c_custkey").alias("k"))
        .agg(F.min("c_name").alias("name"), F.min_by("c_mktsegment", "c_custkey").alias("sector"),
             F.min_by("c_nationkey", "c_custkey").alias("nation"))
        .withColumn("listing", both_listings())
        .select(listing_id().alias("id"), F.concat(figi_of(F.col("k")), F.when(F.col("listing") == "UW", "W").otherwise("")).alias("figi"),
                "name", "sector", "nation", "k")
    )


def v_universe(spark: SparkSession, d: str) -> DataFrame:
    """Index A: every security outside the AUTOMOBILE segment."""
    return v_securities(spark, d).where(F.col("sector") != "AUTOMOBILE").select("id", "figi")


def v_universe_b(spark: SparkSession, d: str) -> DataFrame:
    """Index B, the sub-index removed from A for the training universe."""
    return v_securities(spark, d).where(F.col("sector") == "BUILDING").select("id", "figi")


def v_members(spark: SparkSession, d: str) -> DataFrame:
    s = v_securities(spark, d)
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("k") * 30).cast("int"))
    return s.select(
        F.lit("IDX").alias("index_id"), "id", start.alias("start_date"),
        F.when(F.col("k") % 3 == 0, F.add_months(start, 48)).alias("end_date"),
    )


def v_rebalance_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.trunc(F.to_date("o_orderdate"), "quarter").alias("rebalance_date")).distinct()


# --------------------------------------------------------- statements
def v_reports(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    as_of = F.to_date("o_orderdate")
    suffix = F.when(F.col("o_orderkey") % 2 == 0, " UN Equity").otherwise(" UW Equity")
    return o.select(
        as_of.alias("as_of"),
        F.concat(F.lit("T"), cust_key("o_custkey").cast("string"), suffix).alias("id"),
        F.date_sub(F.trunc(as_of, "quarter"), 1).alias("period_end"),
        F.col("o_orderkey").alias("seq"),
    )


def _quarterly_sums(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.groupBy(cust_key("o_custkey").alias("k"), quarter_end(F.to_date("o_orderdate")).alias("period_end")).agg(
        F.sum("l_extendedprice").alias("rev"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("gross"),
        F.sum("l_quantity").alias("shares"),
    )


def v_facts(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly statement facts, first vintage: (k, id, statement, item_no, item, period_end, publish_date, value)."""
    q = _quarterly_sums(spark, d)
    pretax = F.col("gross") - F.lit(0.95) * F.col("rev")
    cash = r4(F.col("rev") * 0.1)

    def item(spec, value):
        st, no, label = spec
        return F.struct(F.lit(st).alias("statement"), F.lit(no).alias("item_no"), F.lit(label).alias("item"),
                        value.cast("double").alias("value"))

    items = F.array(
        item(IS_REVENUE, r4(F.col("rev"))),
        item(IS_GROSS, r4(F.col("gross"))),
        item(IS_FX, F.lit(0.0)),
        item(IS_PRETAX_ADJ, r4(pretax)),
        item(IS_PRETAX, r4(pretax)),
        item(IS_SHARES, r4(F.col("shares"))),
        item(IS_EPS_XO, r4(pretax / F.col("shares"))),
        item(IS_EPS, r4(F.lit(1.01) * pretax / F.col("shares"))),
        item(BS_CASH_STI, cash),
        item(BS_CASH, cash),
    )
    return q.withColumn("listing", both_listings()).select(
        "k", listing_id().alias("id"), "period_end",
        F.date_add("period_end", (F.col("k") % 25 + 20).cast("int")).alias("publish_date"),
        F.inline(items),
    ).select("k", "id", "statement", "item_no", "item", "period_end", "publish_date", "value")


def v_vintages(spark: SparkSession, d: str) -> DataFrame:
    """First vintages plus a restatement (+2%, 90 days later) for every fourth
    security; one pass over the facts (the restatement is a generated row)."""
    f = v_facts(spark, d)
    versions = F.when(F.col("k") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    v = f.withColumn("__rev", F.explode(versions))
    restated = F.col("__rev") == 1
    return v.select(
        "k", "id", "statement", "item_no", "item", "period_end",
        F.when(restated, F.date_add("publish_date", 90)).otherwise(F.col("publish_date")).alias("publish_date"),
        F.when(restated, r4(F.col("value") * 1.02)).otherwise(F.col("value")).alias("value"),
    ).withColumn("revision_date", F.col("publish_date"))


def v_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Actual EPS (offset 0) and the consensus estimate of the next period (offset 1) per (id, period_end);
    both are known from the day the period's statements are published."""
    from pyspark.sql import Window

    f = v_facts(spark, d).where(F.col("item_no") == EPS_ITEM_NO)
    w = Window.partitionBy("id").orderBy("period_end")
    f = f.withColumn("next_eps", F.lead("value").over(w))
    act = f.select("id", "period_end", "publish_date", F.lit("A").alias("act_est"), F.lit(0).alias("offset"), F.col("value"))
    est = f.where(F.col("next_eps").isNotNull()).select(
        "id", "period_end", "publish_date", F.lit("E").alias("act_est"), F.lit(1).alias("offset"),
        r4(F.col("next_eps") * (1 + ((F.col("k") % 7) - 3) / 50.0)).alias("value"),
    )
    return act.unionByName(est)


def v_fx(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    qe = o.select(quarter_end(F.to_date("o_orderdate")).alias("rate_date")).distinct()
    groups = qe.select("rate_date", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ccy_group"))
    qn = F.year("rate_date") * 4 + F.quarter("rate_date")
    # group 1 has no rate for second quarters, so the last one before holds
    groups = groups.where((F.col("ccy_group") != 1) | (F.quarter("rate_date") != 2))
    # group 2 has an earlier version of every rate, on the same day
    groups = groups.withColumn("version", F.explode(F.when(F.col("ccy_group") == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    return groups.select("rate_date", "ccy_group", "version", (1 + ((qn + F.col("ccy_group") + 3 * (2 - F.col("version"))) % 5) / 100.0).alias("rate"))


def v_industries(spark: SparkSession, d: str) -> DataFrame:
    """Dated industry levels: a first version replaced on its own day, a new
    classification in mid January 2024, and securities with two levels or none."""
    s = v_securities(spark, d).where(F.col("k") % 7 != 6)
    rows = s.withColumn("r", F.explode(F.array(
        F.struct(F.lit("2023-01-02").cast("date").alias("valid_from"), F.lit(1).alias("version"), F.lit("old ").alias("tag")),
        F.struct(F.lit("2023-01-02").cast("date").alias("valid_from"), F.lit(2).alias("version"), F.lit("").alias("tag")),
        F.struct(F.lit("2024-01-15").cast("date").alias("valid_from"), F.lit(1).alias("version"), F.lit("new ").alias("tag")))))
    one = F.concat("r.tag", "sector")
    two = F.concat_ws("/", one, F.col("nation").cast("string"))
    three = F.when(F.col("k") % 5 != 4, F.concat_ws("/", two, (F.col("k") % 3).cast("string")))
    return rows.select(F.col("id").alias("security"), "r.valid_from", "r.version", one.alias("level_1"), two.alias("level_2"), three.alias("level_3"),
                       F.concat(three, F.lit("/"), (F.col("k") % 2).cast("string")).alias("level_4"))


# -------------------------------------------------- prices and trades
def v_prices(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.groupBy(sec_id(user_key()).alias("id"), F.to_date("ts").alias("date")).agg(
        r4(100 + F.avg("value")).alias("px"))


def v_actions(spark: SparkSession, d: str) -> DataFrame:
    """Corporate actions, one row for each day with a price: a hundredth is paid
    on the 10th and 20th, two shares for one on the 15th, nothing otherwise."""
    p = v_prices(spark, d)
    return p.select("id", F.col("date").alias("ex_date"), F.when(F.dayofmonth("date").isin(10, 20), r4(F.col("px") / 100)).otherwise(0.0).alias("dividend"),
                    F.when(F.dayofmonth("date") == 15, 2.0).otherwise(1.0).alias("split"))


def v_stock_prices(spark: SparkSession, d: str) -> DataFrame:
    """Daily prices over the years of the reports, from all orders, for both listings of a company."""
    o = table(spark, d, "orders")
    p = o.groupBy(cust_key("o_custkey").alias("k"), F.to_date("o_orderdate").alias("date")).agg(
        r4(F.avg("o_totalprice") / 1000).alias("px"))
    return p.withColumn("listing", both_listings()).select(listing_id().alias("id"), "date", "px")


def v_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Trading calendar: every weekday between the first and last event day, with a dense index."""
    from pyspark.sql import Window

    ev = table(spark, d, "events")
    b = ev.agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    days = b.select(F.explode(F.sequence("lo", "hi")).alias("date")).where(~F.dayofweek("date").isin(1, 7))
    return days.withColumn("idx", F.row_number().over(Window.orderBy("date")))


def v_weights_bm(spark: SparkSession, d: str) -> DataFrame:
    p = v_prices(spark, d)
    tot = p.groupBy("date").agg(F.sum("px").alias("tot"))
    return p.join(tot, "date").select("date", "id", (F.col("px") / F.col("tot")).alias("w"))


def v_beta(spark: SparkSession, d: str) -> DataFrame:
    p = v_prices(spark, d)
    return p.groupBy("id", F.date_trunc("week", "date").cast("date").alias("week")).agg(
        F.max("date").alias("date"), (F.max_by("px", "date") / 100.0).alias("beta"))


DECISION_BY_TYPE = {"purchase": "BUY", "error": "SELL", "view": "HOLD"}


def v_trades(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    dec = F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "error", "SELL") \
        .when(F.col("event_type") == "view", "HOLD").otherwise("Missing")
    return ev.select(
        F.to_date("ts").alias("date"), sec_id(user_key()).alias("security"), dec.alias("decision"),
        F.floor(F.col("value") / 10).cast("string").alias("confidence"),
        F.col("event_id").alias("seq"), "event_type",
    )


def v_event_days(spark: SparkSession, d: str) -> DataFrame:
    """The busiest day of each week (the earliest, if tied), weekends included."""
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    first = F.struct(-F.col("n"), F.col("date"))
    return days.groupBy(F.date_trunc("week", "date").alias("week")).agg(F.min_by("date", first).alias("date")).select("date")


# -------------------------------------------------- model responses
def v_responses(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    eid = F.col("event_id").cast("string")
    t = F.col("event_type")
    raw = (
        F.when(t == "purchase", F.concat(F.lit('Analysis done.\n```json\n{"decision": "BUY", "confidence score": 8, "reason": "r'), eid, F.lit('"}```\nEnd.')))
        .when(t == "error", F.concat(F.lit('```json\n{"decision": "SELL", "confidence": '), (F.col("event_id") % 10).cast("string"), F.lit("}```")))
        .when(t == "view", F.concat(F.lit('Intro ```json{"decision": "HOLD", "confidence": 5, "id": '), eid, F.lit("}")))
        .when(t == "click", F.concat(F.lit("I would BUY this stock, ref "), eid))
        .otherwise(F.concat(F.lit("BUY or SELL? Unclear "), eid))
    )
    return ev.select(
        F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")).alias("run_name"),
        F.to_date("ts").alias("date"), sec_id(user_key()).alias("security"),
        F.col("event_id"), raw.alias("response_raw"),
    )


def v_earnings_responses(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    t = F.col("event_type")
    raw = (
        F.when(t == "purchase", F.lit('```json{"earnings": "INCREASE", "magnitude": "SMALL", "confidence": 7}```'))
        .when(t == "error", F.lit('```json{"analyst_direction": "decrease", "analyst_magnitude": "LARGE", "reason": "x", "confidence": "6", "thought_process": "y"}```'))
        .when(t == "view", F.lit("{'earnings': 'INCREASE', 'magnitude': 'VERY LARGE', 'confidence': 8, 'reason': 'text'}"))
        .when(t == "click", F.lit('```json{"earnings": "DECREASE", "magnitude": "FLAT", "confidence": 3}```'))
        .otherwise(F.lit("no answer"))
    )
    return ev.select(
        F.concat(F.lit("run"), (F.col("event_id") % 3).cast("string")).alias("run_name"),
        F.to_date("ts").alias("date"), sec_id(user_key()).alias("security"), F.col("event_id"), raw.alias("response_raw"),
    )


def v_agent_results(spark: SparkSession, d: str) -> DataFrame:
    ed = F.element_at(F.array(*[F.lit(x) for x in ("increase", "INCREASE", " Increase ", "decrease")]),
                      (F.col("seq") % 4 + 1).cast("int"))
    return v_trades(spark, d).select(
        "date", "security", "decision", "confidence", "seq", ed.alias("earning_decision"),
        F.upper("event_type").alias("earning_magnitude"))


def v_ft_text(spark: SparkSession, d: str) -> DataFrame:
    e = v_estimates(spark, d).where(F.col("act_est") == "E")
    k = F.regexp_extract("id", r"^T(\d+) ", 1).cast("int")
    bad = (k + F.month("period_end")) % 11 == 0
    return e.select("id", "period_end",
                    F.when(bad, F.lit("N/A per share")).otherwise(
                        F.concat(F.format_string("%.4f", F.col("value")), F.lit(" per share"))).alias("response"))


def v_votes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    turn = (F.col("o_orderkey") % 9 + 1).cast("int")
    pr = F.substring("o_orderpriority", 1, 1)
    vote = F.when(pr.isin("1", "2"), "BUY").when(pr.isin("3", "4"), "SELL").otherwise("HOLD")
    return o.select(
        F.expr("o_orderkey div 9").alias("debate"), turn.alias("turn"),
        F.element_at(F.array(F.lit("BUY"), F.lit("SELL"), F.lit("HOLD")), ((turn - 1) % 3 + 1)).alias("agent"),
        vote.alias("vote"),
    )


def v_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 4).alias("worker"), F.col("l_quantity").alias("n_tokens"),
        F.col("l_shipdate").alias("start_ts"),
        (F.col("l_shipdate") + F.make_interval(hours=F.col("l_linenumber"))).alias("end_ts"),
    )


def v_done(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").where(F.col("event_type") == "purchase")
    return ev.select(F.to_date("ts").alias("date"), sec_id(user_key()).alias("security")).distinct()
