"""Trade list CSV source (SRC10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The trade report columns of the reference.
TRADE_COLUMNS = ("Date", "Security", "Decision", "Confidence")

TRADE_SCHEMA = T.StructType([
    T.StructField("Date", T.DateType()), T.StructField("Security", T.StringType()),
    T.StructField("Decision", T.StringType()), T.StructField("Confidence", T.StringType()),
])


def read_trade_list(spark: SparkSession, path: str) -> DataFrame:
    """A trade report CSV projected to its four columns by header name (every
    column read as text, no inference pass; the date is cast once)."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(
        F.to_date("Date").alias("date"), F.col("Security").alias("security"),
        F.col("Decision").alias("decision"), F.col("Confidence").alias("confidence"),
    )


def write_trade_list(trades: DataFrame, path: str) -> None:
    trades.select(*[trades[c.lower()].alias(c) for c in TRADE_COLUMNS]).write.mode("overwrite") \
        .option("header", True).csv(path)
