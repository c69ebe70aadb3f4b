"""The corpus pipeline: quality, near duplicates, contamination, privacy, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  ``run`` writes each stage's result as
Parquet under the shared folder and reads it again as the next stage's input.
No rows give no rows; further columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.llm import decontamination, jaccard_join, pii, quality_classifier
from pitwise.llm.queries import tokenizer
from pitwise.llm.tables import settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (labels of two folds of three)
    rejects go; null and empty texts get the model's constant, repeated rows
    are judged one by one."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, Jaccard 0.8) the row of
    the least doc_id stays; copies go whether their ids are null, repeated or
    different.  Rows without words stay."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go; null and empty
    texts stay, as do rows of one doc_id with other texts."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds; n_chars follows the
    text.  Every row stays."""
    out = pii.redact_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes, for every
    row; null and empty texts have no ids."""
    t = tokenizer(spark)
    return t.decode(t.encode(docs)).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality), ("jaccard_join", one_of_each), ("decontamination", uncontaminated), ("pii", redacted), ("byte_bpe", tokens),
]

#: No SQL for run()'s rows: the classifier and the tokenizer have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return settle(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
