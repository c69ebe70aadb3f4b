"""Nested point-in-time store as JSON text (SRC2, SRC3, SC6, SC12).

The reference keeps ``{date: {security: {is, bs, px, mt}}}`` with the
statement parts JSON-encoded twice.  Here a store file holds one JSON line
per (date, security); ``is``/``bs`` carry the statement object as a JSON
string (the second encoding) and ``px`` a ``{"Price": {epoch_ms: px}}``
string.  Any DataFrame with the same columns can be passed instead of a
path (SRC3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE_SCHEMA = T.StructType([
    T.StructField("as_of", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("is", T.StringType()), T.StructField("bs", T.StringType()), T.StructField("px", T.StringType()),
    T.StructField("mt", T.StructType([T.StructField("name", T.StringType()), T.StructField("figi", T.StringType()),
                                      T.StructField("sector", T.StringType())])),
])
PRICE_SCHEMA = "map<string,map<string,double>>"


def write_store(nested: DataFrame, path: str, compression: str = "gzip") -> None:
    """The texts repeat every item's label in each period, so the files are
    compressed (one per task; readers take them as they are)."""
    nested.select(F.col("as_of").cast("string").alias("as_of"), "id", F.col("is_json").alias("is"),
                  F.col("bs_json").alias("bs"), *[c for c in ("px", "mt") if c in nested.columns]) \
        .write.mode("overwrite").option("compression", compression).json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(STORE_SCHEMA).json(path)
    return df.select(F.col("as_of").cast("date").alias("as_of"), "id", F.col("is").alias("is_json"),
                     F.col("bs").alias("bs_json"), "px", "mt")


def explode_prices(store: DataFrame) -> DataFrame:
    """M4/SC6: the price part to (as_of, id, date, px); keys are epoch milliseconds."""
    p = store.where(F.col("px").isNotNull()).select(
        "as_of", "id", F.explode(F.from_json("px", PRICE_SCHEMA)["Price"]).alias("ms", "px"))
    return p.select("as_of", "id", F.to_date(F.timestamp_millis(F.col("ms").cast("long"))).alias("date"), "px")
