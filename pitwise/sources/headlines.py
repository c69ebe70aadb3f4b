"""Headline sources and sinks (SRC1, SRC4, FLT2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vendor snapshot columns and the file-name filter of the
# reference's headline scan.
RAW_COLUMNS = ("SUID", "Headline", "TimeOfArrival", "Assigned_ID_BB_GLOBAL", "WireName", "LanguageString")
SNAPSHOT_GLOB = "*EID80001*csv*"

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])
CANONICAL = {"SUID": "suid", "Headline": "headline", "TimeOfArrival": "arrival",
             "Assigned_ID_BB_GLOBAL": "figi", "WireName": "wire", "LanguageString": "language"}


def read_headline_csv(spark: SparkSession, path: str, glob: str | None = SNAPSHOT_GLOB) -> DataFrame:
    """SRC1: daily CSV snapshots (header, multi-line quoted fields), every column
    a string, an explicit schema (no inference pass over the data).

    The escape character is the quote itself (RFC 4180 doubled quotes).  The
    reference passes an empty escape, whose purpose is to switch off Spark's
    default backslash escape; both read backslashes literally, and this one
    also reads a doubled quote inside a quoted headline as one quote.
    Multi-line CSV files are not splittable, so each snapshot file is one
    task: daily snapshots keep those tasks bounded."""
    r = (spark.read.schema(RAW_SCHEMA).option("header", True).option("multiLine", True)
         .option("escape", "\""))
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.csv(path)


def to_canonical(raw: DataFrame) -> DataFrame:
    """Vendor column names to the library's headline schema; arrival parsed
    with ``try_to_timestamp`` (FLT2: bad values become NULL, not errors)."""
    out = raw.select(*[F.col(src).alias(dst) for src, dst in CANONICAL.items()])
    return out.withColumn("arrival", F.try_to_timestamp("arrival"))


def write_headline_csv(df: DataFrame, path: str) -> None:
    """Canonical headlines written back in the vendor layout (for round trips)."""
    inv = {v: k for k, v in CANONICAL.items()}
    out = df.select(*[F.col(c).cast("string").alias(inv[c]) for c in CANONICAL.values()])
    out.write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def write_headline_parquet(df: DataFrame, path: str) -> None:
    """SRC4: parquet partitioned by arrival month, so time ranges prune files."""
    (df.withColumn("arrival_month", F.date_format("arrival", "yyyy-MM"))
       .write.mode("overwrite").partitionBy("arrival_month").parquet(path))


def read_headline_parquet(spark: SparkSession, path: str, start=None) -> DataFrame:
    """SRC4 source; a start time becomes a partition filter plus a pushed row filter."""
    df = spark.read.parquet(path)
    if start is not None:
        ts = F.lit(start).cast("timestamp")
        df = df.where((F.col("arrival_month") >= F.date_format(ts, "yyyy-MM")) & (F.col("arrival") >= ts))
    return df.drop("arrival_month")
