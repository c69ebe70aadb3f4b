"""Quality rules: a hashed n-gram log-likelihood ratio beside plain counts.

Words are ``[^\\x20\\x09-\\x0D]+``.  Word 1- and 2-grams are hashed to ``buckets``
counts, once over all documents (the raw corpus) and once over the trusted
ones (the target).  A document's ratio is the mean, over its n-grams, of
log(target share / raw share); it is kept if the base rules pass and the ratio
is at least ``threshold``.  Raw shares are smoothed by one each; the target's
are drawn towards the raw shares with a weight of ``prior`` words, so what a
small target has not seen says little, and what a large one has not seen says
much.  The threshold is fixed, so the same document and counts give the same
verdict, without sampling.

Counts: one pass that explodes n-grams and combines them before the shuffle,
which is bounded by the buckets; the trusted flags join by doc_id (texts are
shuffled, flags are the hash side; a hot doc_id can be split).  Scores: one pass without a shuffle; the
ratio table, of ``buckets`` doubles, is a scalar subquery.

Rows: null and empty texts have no words, fail the base rules and have ratio
0; repeated rows are judged and counted one by one; an empty trusted set gives
a flat target; of several labels of one doc_id the least counts.  Only doc_id,
text and the labels' doc_id and quality are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.llm.tables import settle, spread

BUCKETS = 1 << 16
PRIOR = 4 * BUCKETS
THRESHOLD = -0.15
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda w: w != "")


def _grams(words: Column, buckets: int) -> Column:
    """Bucket of each word 1-gram and 2-gram."""
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    one = F.transform(words, lambda w: bucket(F.xxhash64(w)))
    two = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                     lambda a, b: bucket(F.xxhash64(a, b)))
    return F.concat(one, two)


def _windows(words: Column, run: int) -> Column:
    """Hashes of all run-word windows of the text."""
    n = F.size(words)
    return F.when(n > run, F.transform(F.sequence(F.lit(1), n - run + 1), lambda i: F.xxhash64(F.slice(words, i, run))))


def _placed(windows: Column) -> Column:
    """The windows with their places, sorted, if any occurs twice."""
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _covered(placed: Column, run: int) -> Column:
    """Words covered by windows that occur twice or more, from a column of placed windows."""
    # neighbours of the sorted array are equal where a window occurs again
    marked = F.transform(placed, lambda x, k: F.when(
        (F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"]), x["i"]))
    starts = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct((i + run).alias("end"), (acc["n"] + i + run - F.greatest(acc["end"], i)).alias("n")),
        lambda acc: acc["n"])


def base_counts(docs: DataFrame, run: int = 8) -> DataFrame:
    """docs' doc_id and words, with the counts of the base rules."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select("doc_id", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    # a column used more than once gets a projection of its own, so that it is evaluated once
    counted = one.select(
        "doc_id", words_of(F.col("text")).alias("words"), lines.alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    counted = counted.select(
        "doc_id", "words", "n_symbols", F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _windows(F.col("words"), run).alias("windows"))
    return counted.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        _placed(F.col("windows")).alias("again"))


def gram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target) over all documents and the trusted ones (a table of doc_id)."""
    flags = trusted.filter("doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.join(spread(flags).hint("shuffle_hash"), rows["doc_id"] == flags["_trusted"], "left")
    rows = rows.select(F.col("_trusted").isNotNull().cast("long").alias("t"), words_of(F.col("text")).alias("words"))
    grams = rows.select("t", F.explode(_grams(F.col("words"), buckets)).alias("bucket"))
    return settle(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")), "gram-counts")


def ratio_table(counts: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row: an array with the log ratio of each bucket."""
    spark = counts.sparkSession
    sums = counts.select(F.sum("raw").alias("r"), F.sum("target").alias("t"))
    filled = spark.range(buckets).join(counts, F.col("id") == F.col("bucket"), "left").select("id", "raw", "target")
    ordered = filled.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("x"))
    both = ordered.select("x", sums.select("r").scalar().alias("r"), sums.select("t").scalar().alias("t"))
    raw_share = lambda x: (x["raw"] + 1.0) / (F.coalesce("r", F.lit(0)) + float(buckets))
    target_share = lambda x: (x["target"] + prior * raw_share(x)) / (F.coalesce("t", F.lit(0)) + float(prior))
    return both.select(F.transform("x", lambda x: F.log(target_share(x) / raw_share(x))).alias("ratios"))


def judge_quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, run: int = 8,
                  prior: float = PRIOR) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, ratio (mean log-likelihood ratio)."""
    table = ratio_table(gram_counts(docs, trusted, buckets), buckets, prior)
    base = base_counts(docs, run)
    scored = base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(_covered(F.col("again"), run), F.lit(0).cast("long")).alias("n_repeat_words"),
        _grams(F.col("words"), buckets).alias("grams"), table.scalar().alias("ratios"))
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(F.col("ratios"), g))
    scored = scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", total.alias("total"),
        F.greatest(2 * F.col("n_words") - 1, F.lit(1)).alias("n_grams"))
    ratio = F.col("total") / F.col("n_grams")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (ratio >= threshold)).alias("kept"), ratio.alias("ratio"))
