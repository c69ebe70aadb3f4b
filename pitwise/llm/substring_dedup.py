"""Substring dedup by seed and extend.

A window is ``length`` consecutive words of one document.  Every word covered
by a window whose words also start anywhere else (same document included) is
removed.

1. Seeds: winnowing selects 8-grams such that each window holds at least one,
   at a place that depends on the window's words only.
2. Join: occurrences of a seed meet on its hash.  Counts are combined before
   the shuffle, and the join back is splittable, so a passage in a third of
   all documents is no hot task.
3. Extend: each occurrence carries the hash of its neighbourhood, which is all
   windows around the seed (as far as the document reaches both ways).
   Occurrences with equal neighbourhoods repeat wholly.  Where neighbourhoods
   of one seed differ, one occurrence of each is extended window by window:
   128-bit hashes of all windows around the seed are counted.
4. The union of the repeated stretches (the maximal repeats) is removed.

Rows: null or empty texts have no words and keep ``sha256('')``; texts under
``length`` words lose nothing; rows that repeat, even with one id, are
documents of their own, so their windows repeat; a null doc_id is a value like
any other.  Only doc_id and text are read.  No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.llm.tables import keyed, same_row, settle, spread
from pitwise.llm.tokens import Words, chunks, winnow

GRAM = 8


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _seeds(length: int):
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi])
                p, seed = winnow(w, GRAM, reach + 1)
                d = w.doc[p]
                s = np.maximum(w.first[d], p - reach)
                e = np.minimum(w.first[d + 1], p + length)
                around = w.runs(s, e) ^ (p - s + 1).astype(np.uint64)
                rows = pa.array(d + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("th").take(rows), _signed(seed), _signed(around),
                     pa.array((s - w.first[d]).astype(np.int32)), pa.array((e - w.first[d]).astype(np.int32))],
                    ["doc_id", "th", "seed", "around", "s", "e"])

    return run


def _windows(length: int):
    """All windows within the given stretches of each text, with 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), batch.column("at").to_pylist()
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi])
                n = len(w.start)
                starts, ends = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
                for d in range(lo, hi):
                    base = w.first[d - lo]
                    for x in at[d]:
                        starts[base + x["s"]] += 1
                        ends[base + x["e"] - length] += 1
                open_ = np.cumsum(starts) - np.concatenate(([0], np.cumsum(ends)[:-1]))
                p = np.flatnonzero(open_[:n] > 0)
                d = w.doc[p]
                rows = pa.array(d + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("th").take(rows),
                     _signed(w.runs(p, p + length)), _signed(w.runs(p, p + length, 1)),
                     pa.array((p - w.first[d]).astype(np.int32))],
                    ["doc_id", "th", "a", "b", "s"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, at = batch.column("text").to_pylist(), batch.column("at").to_pylist()
        n_words, n_removed, kept, sha = [], [], [], []
        for t, spans in zip(texts, at, strict=True):
            words = t.encode("utf-8", "surrogatepass").split() if t else []  # bytes.split: \x20 and \x09-\x0D
            left = words
            if spans:
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, [x["s"] for x in spans], 1)
                np.add.at(step, [x["e"] for x in spans], -1)
                left = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
            text = b" ".join(left)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(text)
            sha.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, th, at: array of (s, e)) for documents with repeated stretches;
    s and e count words, e exclusive; stretches may overlap."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    rows, id_type = keyed(docs), docs.schema["doc_id"].dataType
    key = T.StructType([T.StructField("doc_id", id_type), T.StructField("th", T.LongType())])
    ints = [T.StructField(c, T.IntegerType()) for c in ("s", "e")]
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    seeds = rows.mapInArrow(_seeds(length), T.StructType([*key.fields, *longs("seed", "around"), *ints]))
    often = (
        seeds.groupBy("seed").agg(F.count("*").alias("n"), F.min("around").alias("x"), F.max("around").alias("y"))
        .filter("n > 1").select("seed", (F.col("x") != F.col("y")).alias("differ"))
    )
    met = settle(seeds.join(spread(often), "seed"), "repeat-seeds")
    mixed = met.filter("differ")
    groups = mixed.groupBy("seed", "around").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "s", "e")).alias("one"))
    whole = met.filter("not differ").select("doc_id", "th", "s", "e").union(
        mixed.join(spread(groups.filter("n > 1").select("seed", "around")), ["seed", "around"]).select("doc_id", "th", "s", "e"))
    ones = groups.select("one.*").groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("at"))
    near = rows.join(ones.hint("shuffle_hash"), same_row(rows, ones)).select(rows["doc_id"], rows["th"], "text", "at")
    windows = near.mapInArrow(_windows(length), T.StructType([*key.fields, *longs("a", "b"), T.StructField("s", T.IntegerType())]))
    twice = windows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    single = windows.join(spread(twice), ["a", "b"]).select("doc_id", "th", "s", (F.col("s") + length).alias("e"))
    return whole.union(single).groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("at"))


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by one space), kept_sha256 for every row of docs."""
    rows, spans = keyed(docs), repeated_spans(docs, length)
    joined = rows.join(spans.hint("shuffle_hash"), same_row(rows, spans), "left").select(rows["doc_id"], "text", "at")
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(_cut, schema)
