"""Benchmark decontamination by winnowing.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased.  A window is 13 consecutive words of an item; an item of fewer
words, but not none, is one window.  A document word inside any occurrence of
a window is hit.

Fingerprints are the least of every 9 consecutive 5-gram hashes, so any shared
run of 13 words has a fingerprint in common, at the same place (windows of
short items are fingerprints of their own, looked up at every position of
their length).  Document fingerprints first pass a bitmap of the benchmark's
(2**22 bits, whatever the benchmark's size; a false pass only costs a row),
then join them exactly.  Hits are extended to every window that holds the
fingerprint, and those windows join the benchmark's windows on 128-bit hashes.

Rows: null and empty texts have no words and are clean; repeated rows and
repeated or null doc_ids are judged row by row; items without text or words
have no window; items without item_id hit words but are in no list.  An empty
benchmark leaves all documents clean.  Only doc_id, item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.llm.tables import bitmap, keyed
from pitwise.llm.tokens import Words, chunks, winnow

WINDOW, GRAM = 13, 5
RUN = WINDOW - GRAM + 1
BITS = 22

_SPOT = pa.struct([("s", pa.int32()), ("l", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
_PRINT = pa.struct([("seed", pa.int64()), ("at", pa.list_(_SPOT))])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, l, a, b) per window and, with a null, the fingerprints (l, seed)."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in chunks(texts):
            w = Words(texts[lo:hi], "alnum", True)
            i = np.arange(len(w.start))
            size = np.minimum(WINDOW, w.count[w.doc])
            p = i[i + size <= w.stop]
            p = p[(size[p] == WINDOW) | (p == w.first[w.doc[p]])]
            rows, e = pa.array(w.doc[p] + lo), p + size[p]
            long_, short = winnow(w, GRAM, RUN), p[size[p] < WINDOW]
            seeds = np.concatenate((long_[1], w.runs(short, short + size[short])))
            sizes = np.concatenate((np.full(len(long_[0]), WINDOW), size[short]))
            n, m = len(p), len(seeds)
            longs = lambda a, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(a.view(np.int64)), pa.nulls(after, pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([batch.column("item_id").take(rows), pa.nulls(m, batch.column("item_id").type)]),
                 pa.array(np.concatenate((size[p], sizes)).astype(np.int32)),
                 longs(w.runs(p, e), 0, m), longs(w.runs(p, e, 1), 0, m), longs(seeds, n, 0)],
                ["item_id", "l", "a", "b", "seed"])


def _fingerprints(bitmap: np.ndarray, short: list[int]):
    mask = np.uint64((1 << BITS) - 1)

    def known(seed: np.ndarray) -> np.ndarray:
        at = (seed & mask).astype(np.int64)
        return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi], "alnum", True)
                n, i = len(w.start), np.arange(len(w.start))
                p, seed = winnow(w, GRAM, RUN)
                p, seed = (x[known(seed)] for x in (p, seed))
                # windows that hold the fingerprint: starts from p-RUN+1 to p
                s = (p[:, None] - np.arange(RUN - 1, -1, -1)).ravel()
                of = np.repeat(np.arange(len(p)), RUN)
                ok = (s >= w.first[w.doc[p]][of]) & (s + WINDOW <= w.stop[p][of])
                s, of, size = s[ok], of[ok], np.full(int(ok.sum()), WINDOW)
                for k in short:
                    q = i[i + k <= w.stop]
                    h = w.runs(q, q + k)
                    q, h = (x[known(h)] for x in (q, h))
                    of = np.concatenate((of, len(p) + np.arange(len(q))))
                    s, size = np.concatenate((s, q)), np.concatenate((size, np.full(len(q), k)))
                    p, seed = np.concatenate((p, q)), np.concatenate((seed, h))
                spots = pa.StructArray.from_arrays(
                    [pa.array((s - w.first[w.doc[s]] if n else s).astype(np.int32)), pa.array(size.astype(np.int32)),
                     pa.array(w.runs(s, s + size).view(np.int64)), pa.array(w.runs(s, s + size, 1).view(np.int64))], fields=list(_SPOT))
                bounds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(p)))))
                order = np.argsort(w.doc[p], kind="stable") if len(p) else p
                prints = pa.StructArray.from_arrays(
                    [pa.array(seed.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spots)], fields=list(_PRINT)).take(pa.array(order))
                per_doc = np.concatenate(([0], np.cumsum(np.bincount(w.doc[p], minlength=hi - lo) if len(p) else np.zeros(hi - lo, int))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("th").slice(lo, hi - lo), pa.array(w.count.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(per_doc.astype(np.int32)), prints)], ["doc_id", "th", "n_words", "prints"])

    return run


def _covered(spans) -> F.Column:
    """Words in the union of spans (s, l), an array."""
    return F.aggregate(
        F.sort_array(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["s"] + x["l"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["s"] + x["l"] - F.greatest(acc["end"], x["s"]))).alias("n")),
        lambda acc: acc["n"].cast("long"))


def contaminated(docs: DataFrame, benchmark: DataFrame, per_hit: int = 20) -> DataFrame:
    """Per row of docs: doc_id, th (a hash of the text), n_words, n_hit,
    n_items, items (sorted strings), contaminated (n_hit > 0 and
    per_hit * n_hit >= n_words)."""
    item_type = benchmark.schema["item_id"].dataType
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _item_windows, T.StructType([T.StructField("item_id", item_type), T.StructField("l", T.IntegerType()), *longs("a", "b", "seed")]))
    windows = items.filter("seed is null").select("l", "a", "b", "item_id").distinct()
    seeds = items.filter("seed is not null").select("seed").distinct()
    # a bitmap of 2**BITS bits, and the lengths of short windows, 12 at most
    short = sorted(r["l"] for r in items.filter(f"seed is not null and l < {WINDOW}").select("l").distinct().collect())
    wanted = bitmap(items.select(F.col("seed").bitwiseAND((1 << BITS) - 1).alias("bit")), "bit", BITS)

    spot = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("l", T.IntegerType()), *longs("a", "b")])
    out = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), *longs("th", "n_words"),
        T.StructField("prints", T.ArrayType(T.StructType([*longs("seed"), T.StructField("at", T.ArrayType(spot))])))])
    rows = keyed(docs).mapInArrow(_fingerprints(wanted, short), out)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # rows without a partner stay; their keys are spread by row number
    prints = rows.select("row", "doc_id", "th", "n_words", F.explode_outer("prints").alias("p")).select(
        "row", "doc_id", "th", "n_words", F.coalesce("p.seed", F.xxhash64("row")).alias("seed"), "p.at")
    hits = prints.join(seeds.withColumn("known", F.lit(True)), "seed", "left").select(
        "row", "doc_id", "th", "n_words", F.explode_outer(F.when(F.col("known"), F.col("at"))).alias("x"))
    hits = hits.select(
        "row", "doc_id", "th", "n_words", F.col("x.s").alias("s"), F.col("x.l").alias("l"),
        F.coalesce("x.a", F.xxhash64("row")).alias("a"), F.coalesce("x.b", F.lit(0).cast("long")).alias("b"))
    found = hits.alias("h").join(
        windows.withColumn("match", F.lit(True)).alias("w"),
        F.expr("h.a = w.a and h.b = w.b and coalesce(h.l, 0) = w.l"), "left").select("row", "doc_id", "th", "n_words", "h.s", "h.l", "item_id", "match")
    per_doc = found.groupBy("row", "doc_id", "th", "n_words").agg(
        F.collect_set(F.when(F.col("match"), F.struct("s", "l"))).alias("spans"),
        F.collect_set(F.when(F.col("match"), F.col("item_id").cast("string"))).alias("items"))
    return per_doc.select("doc_id", "th", "n_words", _covered(F.col("spans")).alias("n_hit"), F.sort_array("items").alias("items")).select(
        "doc_id", "th", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (F.lit(per_hit) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, per_hit: int = 20) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""
    bad = contaminated(docs, benchmark, per_hit).filter("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("th").alias("_bad_th"))
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_bad_th"])
    return docs.join(bad.hint("shuffle_hash"), same, "left_anti")
