"""Run result sinks and sources (SRC5, SRC6, SRC7, SRC8, SRC9, SRC12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_FIELDS = ("date", "security", "response_raw")


ENVELOPE_RESULTS = 1000


def save_run(results: DataFrame, path: str, *, run_name: str | None = None, model: str = "", dataset: str = "",
             system_prompt: str = "", run_date=None, layout: str = "rows",
             envelope_results: int = ENVELOPE_RESULTS) -> None:
    """SRC5: write a run's results with its metadata.

    ``rows``: one JSON line per result with the run metadata as columns (the
    preferred, splittable layout).  ``envelope``: the reference's object
    ``{run_name, run_date, ..., results: [...]}``.  No record gathers a whole
    run or a whole busy day: the results of a (run, date) are spread over
    ``ceil(n / envelope_results)`` envelopes by a hash of the row, so an
    envelope holds about ``envelope_results`` results whatever the skew.
    Every result is written; readers explode all envelopes."""
    meta = {
        "run_date": F.lit(run_date).cast("string") if run_date is not None else F.current_timestamp().cast("string"),
        "model": F.lit(model), "dataset": F.lit(dataset), "system_prompt": F.lit(system_prompt),
    }
    df = results if run_name is None else results.withColumn("run_name", F.lit(run_name))
    df = df.withColumn("date", F.col("date").cast("string"))
    if layout == "rows":
        out = df.select("run_name", *[v.alias(k) for k, v in meta.items()], *[c for c in df.columns if c != "run_name"])
    elif layout == "envelope":
        fields = [c for c in df.columns if c != "run_name"]
        sizes = df.groupBy("run_name", "date").agg(F.count("*").alias("__n"))  # partial aggregation
        parts = F.ceil(F.col("__n") / F.lit(envelope_results))
        part = F.pmod(F.xxhash64(*[F.col(c) for c in fields]), parts)
        # null-safe, so results without a date or run are written too; the hint puts
        # an exchange between the counts and the join, whose hot keys Spark splits
        sizes = sizes.withColumnsRenamed({"run_name": "__run", "date": "__day"}).hint("rebalance")
        same = df["run_name"].eqNullSafe(sizes["__run"]) & df["date"].eqNullSafe(sizes["__day"])
        out = df.join(sizes, same).groupBy("run_name", F.col("date").alias("__d"), part.alias("__p")).agg(
            F.collect_list(F.struct(*fields)).alias("results")).select(
            "run_name", *[v.alias(k) for k, v in meta.items()], "results")
    else:
        raise ValueError(layout)
    out.write.mode("overwrite").json(path)


def load_results(spark: SparkSession, path: str, result_schema: T.StructType, multiline: bool = False) -> DataFrame:
    """SRC6: read saved runs in either layout, in one scan, and return one row
    per result (the elements of ``results`` for envelopes, else the row
    itself, whatever of it is NULL).  The schema is given, never inferred."""
    meta = [T.StructField(c, T.StringType()) for c in ("run_name", "run_date", "model")]
    fields = [f for f in result_schema.fields if f.name not in ("run_name", "run_date", "model")]
    rows = spark.read.option("multiLine", multiline).schema(
        T.StructType([*meta, T.StructField("results", T.ArrayType(T.StructType(fields))), *fields])).json(path)
    itself = F.array(F.struct(*[F.col(f.name) for f in fields]))
    return rows.select("run_name", "run_date", "model", F.explode(F.coalesce("results", itself)).alias("r")).select(
        "run_name", "run_date", "model", "r.*")


def fan_in_logs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC7: every JSON log under a prefix, concatenated, with its file path."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    return df.withColumn("log_file", F.col("_metadata.file_path"))


def write_chunked_log(df: DataFrame, path: str, log_at: int, date_col: str = "date") -> None:
    """SRC8: a file at most every ``log_at`` records, folders named by year."""
    (df.withColumn("year", F.year(date_col)).write.mode("overwrite").partitionBy("year")
       .option("maxRecordsPerFile", log_at).json(path))


def write_training_set(df: DataFrame, path: str) -> None:
    """SRC9: ``{prompt, completion}`` JSON lines (one folder per split)."""
    df.select("prompt", "completion", "split").write.mode("overwrite").partitionBy("split").json(path)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there: its file system has the writer's success marker."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, force_refresh: bool = False) -> DataFrame:
    """SRC12: reuse a dataset written earlier, or build and write it
    (``force_refresh`` rebuilds).  The written table also cuts lineage.  It is
    there if its file system has the writer's success marker; errors of the
    file system, or of reading, are raised, never taken for absence."""
    if force_refresh or not written(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
