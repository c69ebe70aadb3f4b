"""Fine-tuning set assembly as the reference does it (JN4, SRT7, SET4, SC14, SC16, DOM15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.functions.numeric import round_half_up
from pitwise.functions.text import text_before
from pitwise.operators import statements as st
from pitwise.sizing import broadcast_bounded

# Fixed values of the reference's notebook: record cap, split share, the
# marker the prompt is cut at and the cue appended after the cut.
MAX_RECORDS = 10_000
TRAIN_SHARE = 0.8
PROMPT_CUT = "Balance Sheet:"
PROMPT_SUFFIX = "\nThe next period EPS is:"
HEX = "0123456789abcdef"


def seeded_order(date_col: str, seed: str) -> Column:
    """A reproducible shuffle key for dates (md5 of date text and seed)."""
    return F.md5(F.concat(F.date_format(date_col, "yyyy-MM-dd"), F.lit("|"), F.lit(seed)))


def sample_records(records: DataFrame, *, n: int, seed: str = "42", date_col: str = "date",
                   tie: tuple[str, ...] = ("security",)) -> DataFrame:
    """SRT7: dates in a seeded shuffled order, records taken in that order up
    to ``n`` (the cap is the feature; Spark runs it as a per-task top-n)."""
    return records.orderBy(seeded_order(date_col, seed), F.col(date_col), *[F.col(c) for c in tie]).limit(n)


def sampled_statements(matrix: DataFrame, *, n: int = MAX_RECORDS, seed: str = "42") -> DataFrame:
    """SRT7 before DOM14: the rows of a statement matrix that belong to the
    first ``n`` records of the seeded order, so that no more than ``n`` prompts
    are rendered.  The records are the (as_of, id) that have a prompt (an item
    that is not all zero), and the order is that of ``sample_records``; their
    keys, ``n`` at most, are broadcast."""
    keys = st.drop_all_zero_items(matrix).select(F.col("as_of").alias("date"), F.col("id").alias("security")).distinct()
    chosen = sample_records(keys, n=n, seed=seed).select(F.col("date").alias("as_of"), F.col("security").alias("id"))
    return matrix.join(broadcast_bounded(chosen), ["as_of", "id"], "left_semi")


def hash_bucket(*cols: str) -> Column:
    """0..255 from the first two hex digits of md5 of the key (engine independent)."""
    m = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))
    hi = F.instr(F.lit(HEX), F.substring(m, 1, 1)) - 1
    lo = F.instr(F.lit(HEX), F.substring(m, 2, 1)) - 1
    return hi * 16 + lo


def train_test_split(df: DataFrame, keys: list[str], train_share: float = TRAIN_SHARE) -> DataFrame:
    """SET4: a stable hash split (the same record always lands on the same side)."""
    cut = int(round(256 * train_share))
    return df.withColumn("split", F.when(hash_bucket(*keys) < cut, F.lit("train")).otherwise(F.lit("test")))


def completion_text(value: Column, decimals: int = 3) -> Column:
    """SC14: an EPS rounded to 3 decimals, as the shortest text ("1.5"; NULL stays NULL)."""
    return round_half_up(value, decimals).cast("string")


def training_set(prompts: DataFrame, eps_pairs: DataFrame, *, seed: str = "42", n: int = MAX_RECORDS,
                 value_col: str = "analyst_estimated_eps", cue: str = PROMPT_SUFFIX) -> DataFrame:
    """DOM15 as the reference builds it: (date, security) prompts taken in the
    seeded date order up to ``n`` (whether or not an EPS exists), each cut
    before the balance sheet and ending with the completion ``cue``; completion
    = the next-period EPS the data gives as of the date (AGG21's estimate,
    ``eps_pair``) rounded to 3, NULL when there is none; then the split.
    The join runs after the top-``n`` cut, so at most ``n`` rows look up an
    estimate."""
    p = prompts.select(F.col("as_of").alias("date"), F.col("id").alias("security"), "prompt")
    s = sample_records(p, seed=seed, n=n)
    e = eps_pairs.select("security", "date", F.col(value_col).alias("__eps"))
    j = s.join(e, ["security", "date"], "left")
    prompt = F.concat(text_before(F.col("prompt"), PROMPT_CUT), F.lit(cue))
    out = j.select("date", "security", prompt.alias("prompt"), completion_text(F.col("__eps")).alias("completion"))
    return train_test_split(out, ["date", "security"])


def write_training_set(rows: DataFrame, path: str) -> None:
    """DOM15's file: JSON lines of prompt and completion, one folder for each
    split.  A completion that is NULL is written as null."""
    rows.select("prompt", "completion", "split").write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("split").json(path)


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    """prompt, completion, split of such a file; reading one split reads its folder only."""
    return spark.read.schema("prompt string, completion string, split string").json(path)
