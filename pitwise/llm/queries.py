"""Query keys of the operators in this subpackage, over whole tables, and
their DuckDB oracles where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.llm import (
    decontamination, jaccard_join, license_scan, minhash, phrases, pii, quality_classifier, quality_rules, substring_dedup, url_filters, warc, whitening,
)
from pitwise.llm.byte_bpe import Tokenizer
from pitwise.llm.oracles import ORACLES  # noqa: F401
from pitwise.llm.tables import table

URL_RULES: url_filters.Rules = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def tokenizer(spark: SparkSession) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model)


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("redacted")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("alias")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenizer(spark)
    return t.decode(t.encode(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"), trusted.select("doc_id")).drop("ratio")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=35).drop("kept_text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("licenses")


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op12_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, percent=80, top=2000)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it passes 64 bits; deviation_wide has it there too."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), k=8)
    return rows.withColumnRenamed("deviation", "deviation_wide").withColumn("deviation", F.col("deviation_wide").try_cast("long")).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_pii_anchors, op3_url_filters, op4_byte_bpe, op5_decontamination, op6_warc, op7_jaccard_join,
        op8_quality_rules, op9_substring_dedup, op10_license_scan, op11_minhash_near_dedup, op12_phrase_collocation, op13_embedding_whitening)
}
