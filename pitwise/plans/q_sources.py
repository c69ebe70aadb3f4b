"""Query keys for sources and sinks (SRC1-2, SRC4-8, SRC11, FLT10).

Each key derives its data from the driver's tables, writes it with the
sink under test into the shared checkpoint folder and reads it back with
the matching source.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.operators import statements as st
from pitwise.plans import fixtures as fx
from pitwise.plans.catalog import query
from pitwise.plans.q_statements import matrix
from pitwise.session import scratch_path
from pitwise.sources import data_items as di
from pitwise.sources import headlines as hl
from pitwise.sources import pit_store as ps
from pitwise.sources import results as rs

RESULT_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("security", T.StringType()),
                              T.StructField("event_id", T.LongType()), T.StructField("response_raw", T.StringType())])


@query("src_headline_csv", "SELECT suid, headline, arrival, figi, wire, language FROM v_headlines")
def src_headline_csv(spark, d):
    path = scratch_path(spark, "headlines-csv")
    hl.write_headline_csv(fx.v_headlines(spark, d), path)
    return hl.to_canonical(hl.read_headline_csv(spark, path, glob="*.csv"))


@query("src_headline_parquet", """
SELECT suid, headline, arrival, figi, wire, language FROM v_headlines WHERE arrival >= TIMESTAMP '2024-01-05'""")
def src_headline_parquet(spark, d):
    path = scratch_path(spark, "headlines-parquet")
    hl.write_headline_parquet(fx.v_headlines(spark, d), path)
    return hl.read_headline_parquet(spark, path, start="2024-01-05")


_RESULTS_SQL = "SELECT run_name, date, security, event_id, response_raw FROM v_responses"


@query("results_explode", _RESULTS_SQL)
def results_explode(spark, d):
    path = scratch_path(spark, "results-rows")
    rs.save_run(fx.v_responses(spark, d), path, model="stub", run_date="2024-02-01", layout="rows")
    return rs.load_results(spark, path, RESULT_SCHEMA).select("run_name", "date", "security", "event_id", "response_raw")


@query("results_roundtrip", _RESULTS_SQL)
def results_roundtrip(spark, d):
    path = scratch_path(spark, "results-envelope")
    rs.save_run(fx.v_responses(spark, d), path, model="stub", run_date="2024-02-01", layout="envelope")
    return rs.load_results(spark, path, RESULT_SCHEMA).select("run_name", "date", "security", "event_id", "response_raw")


LOG_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("security", T.StringType()),
                           T.StructField("decision", T.StringType()), T.StructField("seq", T.LongType())])


@query("log_fanin", "SELECT date, security, decision, seq FROM v_trades")
def log_fanin(spark, d):
    path = scratch_path(spark, "logs")
    rs.write_chunked_log(fx.v_trades(spark, d).select("date", "security", "decision", "seq"), path, log_at=1000)
    return rs.fan_in_logs(spark, path, LOG_SCHEMA).select("date", "security", "decision", "seq")


@query("data_item_range", """
SELECT id, date, px AS value FROM v_prices WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-19'""")
def data_item_range(spark, d):
    path = scratch_path(spark, "datapack")
    items = di.to_items(fx.v_prices(spark, d), "px_last", "px").unionByName(
        di.to_items(fx.v_beta(spark, d), "beta", "beta")).unionByName(
        di.to_items(fx.v_weights_bm(spark, d), "index_weight", "w"))
    di.write_data_pack(items, path)
    return di.load_item(spark, path, "px_last", "2024-01-08", "2024-01-19")


@query("pit_store_roundtrip", """
SELECT as_of, id, statement, period_label, item, value
FROM v_matrix UNPIVOT (value FOR period_label IN (t, t_1, t_2, t_3, t_4, t_5))""")
def pit_store_roundtrip(spark, d):
    path = scratch_path(spark, "pit-store")
    ps.write_store(st.pit_nest(matrix(spark, d)), path)
    return st.pit_explode(ps.read_store(spark, path))
