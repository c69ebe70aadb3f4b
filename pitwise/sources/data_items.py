"""Data-pack store: typed daily data items in parquet (SRC11, FLT10, M12).

Long rows ``(item, id, date, value)`` partitioned by ``item``: loading one
item over a date range reads only that item's folder (partition pruning)
and pushes the date bounds into the parquet scan (row-group min/max).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The data items of the reference's backtest data pack.
DATA_ITEMS = (
    "index_weight", "trading_calendar", "analyst_rating", "target_price", "cur_mkt_cap",
    "day_to_day_tot_return_gross_dvds", "beta", "px_last",
    "bics_level_1", "bics_level_2", "bics_level_3", "bics_level_4",
)


def to_items(df: DataFrame, item: str, value: str, id_col: str = "id") -> DataFrame:
    return df.select(F.lit(item).alias("item"), F.col(id_col).alias("id"), "date", F.col(value).cast("double").alias("value"))


def write_data_pack(items: DataFrame, path: str, *, overwrite_existing: bool = True) -> None:
    """Write items; ``overwrite_existing`` replaces only the items present
    (dynamic partition overwrite), otherwise existing folders are kept."""
    w = items.write.partitionBy("item")
    if overwrite_existing:
        w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        w = w.mode("append")
    w.parquet(path)


def load_item(spark: SparkSession, path: str, item: str, start=None, end=None) -> DataFrame:
    """FLT10: one item between two dates (inclusive)."""
    df = spark.read.parquet(path).where(F.col("item") == item)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df.select("id", "date", "value")
