"""Tables of the shared folder, and small helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = 512  # rows of an Arrow batch of whole texts
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A query's shuffle files go when it ends, not when the driver next happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FILTER_BITS = 24


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH rows for what runs within: of Spark's
    10,000, a task holds all texts on both sides of its Python worker at once."""
    rows = int(spark.conf.get(_ROWS))
    with _set(spark, _ROWS, str(rows if 0 < rows < BATCH else BATCH)):
        yield


def swept(spark: SparkSession):
    """What a query that is built and run within has shuffled goes when it ends."""
    return _set(spark, _CLEAN, "true")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared checkpoint folder and read it back: cuts the
    lineage, and later uses neither recompute nor depend on lost executors.
    What was shuffled for it is not read again, and goes at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark), swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread(df: DataFrame) -> DataFrame:
    """df, an aggregate, evened out before a join on its keys.  The join then
    has an exchange directly on both sides, and Spark can split the partition
    of a hot key; else the aggregate's own partitioning would be joined as is."""
    return df.hint("rebalance")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and th, a hash of the text.  (doc_id, th) names a row even
    if ids repeat; rows equal in both have the same result."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def among(rows: DataFrame, number: Column, numbers: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """The rows whose number (from 0 on) is in a column of numbers (inside=False:
    the other ones), by a map of bits in blocks of 4,096 bytes that the tasks
    fill, and that are broadcast."""
    at = F.col(column).cast("long") + 1  # blocks count from 1
    blocks = numbers.groupBy(F.bitmap_bucket_number(at).alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_set"))
    own = rows.withColumns({"_block": F.bitmap_bucket_number(number + 1), "_bit": F.bitmap_bit_position(number + 1)})
    byte = F.conv(F.hex(F.substring("_set", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    if inside:
        return own.join(F.broadcast(blocks), "_block").filter(found).select(rows.columns)
    return own.join(F.broadcast(blocks), "_block", "left").filter(~F.coalesce(found, F.lit(False))).select(rows.columns)


def hashed(c: str) -> Column:
    """A number of FILTER_BITS bits, for among()."""
    return F.xxhash64(c).bitwiseAND((1 << FILTER_BITS) - 1)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not among those of gone, a settled table of one
    column of distinct keys.  A map of 2**FILTER_BITS bits tells most of them,
    which are not shuffled; the others are looked up exactly."""
    whole = rows.select(F.col(key).alias("_key"), F.struct("*").alias("_row"))
    gone = gone.select(F.col(gone.columns[0]).alias("_gone"))
    bits = gone.select(hashed("_gone").alias("bit"))
    stay = among(whole, hashed("_key"), bits, "bit", inside=False)
    near = among(whole, hashed("_key"), bits, "bit")
    # an anti-join would be pushed below the map, and all rows shuffled
    near = near.join(spread(gone).hint("shuffle_hash"), near["_key"] == gone["_gone"], "left").filter("_gone is null")
    return stay.select("_row.*").union(near.select("_row.*"))


def bitmap(numbers: DataFrame, column: str, bits: int) -> np.ndarray:
    """The set of numbers from 0 to 2**bits - 1 in a column, as a map of bits
    (least bit of a byte first) that the tasks fill: 2**bits / 8 bytes at most
    reach the driver, however many rows there are."""
    at = F.col(column).cast("long") + 1  # blocks count from 1
    with swept(numbers.sparkSession):
        rows = numbers.filter(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("block")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("set")).collect()
    out = np.zeros(max(1, (1 << bits) // 8, 4096), np.uint8)
    for row in rows:
        out[(row["block"] - 1) * 4096:row["block"] * 4096] = np.frombuffer(row["set"], np.uint8)
    return out
