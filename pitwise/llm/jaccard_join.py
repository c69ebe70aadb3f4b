"""N-gram Jaccard join: rare-first prefix filtering with length, positional
and suffix filters, joined on prefix n-grams and verified once per pair.

A document's set is its distinct word n-grams (A-Z lower-cased; with fewer
words the whole sequence).  Two documents link when
100 * |x & y| >= percent * |x | y|.

1. Classes: documents with equal sets (a 128-bit digest and the size) are one
   class, whose least doc_id stands for it.  Copies need no pairs.
2. Order: n-grams are ordered rare first.  The order comes from two count
   tables of 2**18 buckets over all documents, one of words (whose product
   estimates an n-gram's frequency) and one of n-grams (in which passages that
   many documents share stand out, by six times the spread of a bucket's sum).
   Any fixed order gives the same links; the counts only make prefixes
   selective, at a bounded size.
3. Prefix join: two sets that link share an n-gram among the first
   |x| - ceil(percent*|x|/100) + 1 of each.  Per n-gram, first only its leader
   (the least class) is paired with the others, so a group of thousands of
   near copies costs one pair for each, not all pairs.  Entries of n-grams that
   are in one prefix only are found by counts of 32 bits of them, put into a map
   of 2**26 bits at most, and are not shuffled.
4. Filters: length; positional (what can still match after the first common
   n-gram); suffix (by 64 regions of the n-grams' hashes: the sum of size
   differences bounds the overlap); maps (a bit or two for each n-gram of a
   set, so that long texts do not pass by chance: the bits of both maps, and
   the n-grams beyond one a bit, bound the overlap).
5. Verification: the exact sets of both whole texts, once per pair.
6. Components of the links so far.  Any n-gram whose classes are still in
   different components gives their pairs (none within a component), filtered
   and verified likewise, less the pairs seen before.  So no link between
   components is lost; links within one would change nothing.

Rows: null and empty texts, or texts without words, have an empty set and link
with nothing; rows with one doc_id are one document of the graph, which links
by any of its sets (steps 3, 4 and 6 go by set, step 5 by all texts of the two
ids); rows without doc_id keep their set size and a null component.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.llm.components import connected_components
from pitwise.llm.tables import among, bitmap, hashed, settle, spread, swept, without
from pitwise.llm.tokens import Words, chunks

BUCKETS = 1 << 18
REGIONS = 64
MET_BITS = 26


def _grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word, hash and text of every n-gram (the whole of shorter texts)."""
    i = np.arange(len(w.start))
    size = np.minimum(n, w.count[w.doc])
    p = i[i + size <= w.stop]
    return p, w.runs(p, p + size[p]), w.doc[p]


def _sets(w: Words, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, sorted distinct hashes, a start word of each) of each text."""
    p, h, d = _grams(w, n)
    bounds = np.searchsorted(d, np.arange(len(w.count) + 1))
    for k in range(len(w.count)):
        lo, hi = bounds[k], bounds[k + 1]
        u, at = np.unique(h[lo:hi], return_index=True)
        yield k, u, p[lo:hi][at]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _profile(n: int):
    """Per document its set's size and digest; per task the bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type = np.zeros(2 * BUCKETS, np.int64), None
        for batch in batches:
            texts, id_type = batch.column("text").to_pylist(), batch.column("doc_id").type
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi], "space", True)
                counts[:BUCKETS] += np.bincount(_bucket(w.hash()), minlength=BUCKETS)
                size, a, b = (np.zeros(hi - lo, np.int64) for _ in range(3))
                for k, u, _ in _sets(w, n):
                    if len(u):
                        counts[BUCKETS:] += np.bincount(_bucket(u), minlength=BUCKETS) if len(u) > BUCKETS // 8 else 0
                        if len(u) <= BUCKETS // 8:
                            np.add.at(counts, BUCKETS + _bucket(u), 1)
                        size[k] = len(u)
                        a[k], b[k] = np.frombuffer(hashlib.md5(u.tobytes()).digest(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(size), pa.array(a), pa.array(b), pa.nulls(hi - lo, pa.int32())],
                    ["doc_id", "n", "a", "b", "bucket"])
        at = np.flatnonzero(counts)
        for k in range(0, len(at), 1 << 16):
            q = at[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(q), id_type), pa.array(counts[q]), pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.int64()), pa.array(q.astype(np.int32))],
                ["doc_id", "n", "a", "b", "bucket"])

    return run


def _prefixes(n: int, percent: int, counts: np.ndarray):
    """Per document its prefix (rarest first), its set's sizes in the suffix
    filter's regions, and a map of its set with one to two bits an n-gram."""
    word, gram = counts[:BUCKETS].astype(np.float64), counts[BUCKETS:]
    total = max(1.0, word.sum())
    log_share = np.log(np.maximum(word, 1) / total)
    # a bucket holds many n-grams that few documents share, whose sum varies little; a frequent one stands out by several times that
    low, mid = np.quantile(gram, (0.16, 0.5)) if gram.any() else (0.0, 0.0)
    heavy = max(3.0, mid + 6 * max(1.0, mid - low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi], "space", True)
                sums = np.concatenate(([0.0], np.cumsum(log_share[_bucket(w.hash())])))
                rows, sizes, a, prefix, regions, maps = [], [], [], [], [], []
                for k, u, p in _sets(w, n):
                    size = len(u)
                    # with another set, at best |x & y| = size and |x | y| = size + 1
                    if not size or 100 * size < percent * (size + 1):
                        continue
                    seen = gram[_bucket(u)]
                    # whole steps of the estimate, so that one n-gram ranks alike in every text
                    guess = np.floor(np.log(total) + sums[np.minimum(p + n, len(sums) - 1)] - sums[p] + 0.5)
                    rank = np.where(seen > heavy, np.maximum(np.ceil(np.log(np.maximum(seen - mid, 1))), guess), guess)
                    order = np.lexsort((u, rank))
                    keep = size - -(-percent * size // 100) + 1
                    rows.append(k + lo)
                    sizes.append(size)
                    a.append(int(np.frombuffer(hashlib.md5(u.tobytes()).digest(), np.int64)[0]))
                    prefix.append(u[order[:keep]].view(np.int64))
                    regions.append(np.minimum(np.bincount((u & np.uint64(REGIONS - 1)).astype(np.int64), minlength=REGIONS), 32767).astype(np.int16))
                    maps.append(_map(u))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.array(a, pa.int64()),
                     pa.array(prefix, pa.list_(pa.int64())), pa.array(regions, pa.list_(pa.int16())), pa.array(maps, pa.binary())],
                    ["doc_id", "size", "a", "prefix", "regions", "map"])

    return run


def _map(u: np.ndarray) -> bytes:
    """A map of bits of a set's hashes: a power of two of them, over its size."""
    bits = np.zeros(max(64, 1 << len(u).bit_length()), np.uint8)
    bits[(u & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(x: bytes, xs: int, y: bytes, ys: int) -> int:
    """A bound of what two sets of these maps and sizes share: the bits that are
    set in both maps, and of the hashes beyond one for each bit the fewer."""
    n = min(len(x), len(y))
    p, q = (np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, n // 8)) for m in (x, y))
    ones = lambda m: int(np.bitwise_count(m).sum())
    return ones(p & q) + min(xs - ones(p), ys - ones(q))


def _may_link(percent: int):
    """Of the pairs those whose maps do not rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("xs").to_pylist(), batch.column("ys").to_pylist()
            ok = [(100 + percent) * most_common(x.as_buffer(), m, y.as_buffer(), n) >= percent * (m + n)
                  for x, m, y, n in zip(batch.column("xm"), xs, batch.column("ym"), ys, strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return run


def _entries(met: np.ndarray, bits: int):
    """Per n-gram of a prefix that may be in another one (by the map of cells, 2**bits of them) a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            at, gram = prefix.offsets.to_numpy(), prefix.values.to_numpy()
            cell = gram.view(np.uint64) >> np.uint64(64 - bits)
            found = np.flatnonzero(met[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1)
            found = found[(found >= at[0]) & (found < at[-1])]
            row = np.searchsorted(at, found, "right") - 1
            of = [batch.column(c).take(pa.array(row)) for c in ("id", "a", "size")]
            yield pa.RecordBatch.from_arrays([*of, pa.array((found - at[row]).astype(np.int32)), pa.array(gram[found])], ["id", "a", "size", "pos", "gram"])

    return run


def _verify(n: int, percent: int):
    def sets_of(texts: list[str]) -> list[np.ndarray]:
        out = []
        for lo, hi in chunks(texts):
            out += [u for _, u, _ in _sets(Words(texts[lo:hi], "space", True), n)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x_texts, y_texts = part.column("x_text").to_pylist(), part.column("y_text").to_pylist()
                once = list(dict.fromkeys([*x_texts, *y_texts]))
                sets = dict(zip(once, sets_of(once), strict=True))
                ok = []
                for x, y in zip(x_texts, y_texts, strict=True):
                    x, y = sets[x], sets[y]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return run


def _texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, text of the documents in pairs.  A bitmap of 2**24 bits keeps
    most other texts out of the shuffle; the semi-join is exact."""
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    rows = docs.filter("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    near = among(rows, hashed("doc_id"), ids.select(hashed("id").alias("bit")), "bit")
    return near.join(ids, near["doc_id"] == ids["id"], "left_semi")


def _least_common(x: Column, y: Column, percent: int) -> Column:
    """The overlap at which sets of these sizes link."""
    return F.ceil(F.lit(percent) * (x + y) / F.lit(100 + percent))


def _positional(xs: str, xp: str, ys: str, yp: str, percent: int) -> str:
    """What can still match from a common prefix n-gram on; a pair that links
    passes it at its first one."""
    return f"{100 + percent} * least({xs} - {xp}, {ys} - {yp}) >= {percent} * ({xs} + {ys})"


def _filtered(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """One row (x, y) per pair of ids of which two sets pass the suffix filter
    and that of the maps.  pairs: x, y, the sets' digests xa, ya and sizes xs,
    ys, once for each common prefix n-gram that passes the positional filter."""
    first = pairs.select("x", "y", "xa", "ya", "xs", "ys").distinct()

    def beside(some: DataFrame, column: str, short: str) -> DataFrame:
        for side in "xy":
            own = heads.select(F.col("id").alias(side), F.col("a").alias(f"{side}a"), F.col(column).alias(f"{side}{short}"))
            some = some.join(own, [side, f"{side}a"])
        return some

    apart = F.aggregate(F.zip_with("xr", "yr", lambda a, b: F.abs(a - b)), F.lit(0), lambda a, b: a + b)
    near = beside(first, "regions", "r").filter((F.col("xs") + F.col("ys") - apart) / 2 >= _least_common(F.col("xs"), F.col("ys"), percent)).drop("xr", "yr")
    near = beside(near, "map", "m")
    return near.mapInArrow(_may_link(percent), T.StructType([near.schema["x"], near.schema["y"]])).distinct()


def _links(docs: DataFrame, pairs: DataFrame, n: int, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The pairs, settled, and those that link."""
    pairs = settle(pairs, f"{name}-pairs")
    texts = settle(_texts_of(docs, pairs), f"{name}-texts")
    sides = pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("x_text")), "x").join(
        texts.select(F.col("doc_id").alias("y"), F.col("text").alias("y_text")), "y").select("x", "y", "x_text", "y_text")
    links = sides.mapInArrow(_verify(n, percent), T.StructType([pairs.schema["x"], pairs.schema["y"]])).distinct()
    return pairs, settle(links, f"{name}-links")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (its set's size), component_id (the
    least doc_id reachable by links, itself included)."""
    if not 0 < percent <= 100 or n < 1:
        raise ValueError("n must be at least 1 and percent within 1..100")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    profile = settle(rows.mapInArrow(_profile(n), T.StructType([id_field, *longs("n", "a", "b"), T.StructField("bucket", T.IntegerType())])), "jaccard-profile")
    with swept(docs.sparkSession):
        table = profile.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2**19 rows at most, as columns
    counts = np.zeros(2 * BUCKETS, np.int64)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()

    sized = profile.filter("bucket is null").select("doc_id", F.col("n").alias("n_shingles"), "a", "b")
    classes = sized.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "a", "b").agg(F.min("doc_id").alias("id"))
    classes = spread(classes)
    # rows of one doc_id are one document: their classes are linked from the start
    same_id = sized.filter("n_shingles > 0").join(classes, ["n_shingles", "a", "b"]).filter("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))

    prefix_schema = T.StructType([
        id_field, T.StructField("size", T.IntegerType()), *longs("a"), T.StructField("prefix", T.ArrayType(T.LongType())),
        T.StructField("regions", T.ArrayType(T.ShortType())), T.StructField("map", T.BinaryType())])
    made = rows.filter("doc_id is not null").mapInArrow(_prefixes(n, percent, counts), prefix_schema)
    heads = settle(made.join(classes.select("id", F.col("n_shingles").cast("int").alias("size"), "a").withColumnRenamed("id", "doc_id"), ["doc_id", "size", "a"], "left_semi")
                   .select(F.col("doc_id").alias("id"), "a", "size", "prefix", "regions", "map").dropDuplicates(["id", "a", "size"]), "jaccard-heads")
    # an id has a head, and so entries, for each of its sets; of all entries only 32 bits of the n-gram are shuffled, as
    # counts, and those that meet no other one go out before the rest of them is.  A few that stay alone do no harm
    cells = heads.select(F.explode("prefix").alias("gram")).groupBy(F.shiftright("gram", 32).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    cells = settle(cells.filter("n > 1").select("cell"), "jaccard-cells")
    # eight bits for each, as far as the bound goes: tasks hold the map beside their texts
    bits = min(MET_BITS, max(16, (8 * cells.count()).bit_length()))
    often = bitmap(cells.select(F.shiftright("cell", 32 - bits).bitwiseAND((1 << bits) - 1).alias("cell")), "cell", bits)
    entry_schema = T.StructType([heads.schema["id"], heads.schema["a"], heads.schema["size"], T.StructField("pos", T.IntegerType()), T.StructField("gram", T.LongType())])
    met = settle(heads.select("id", "a", "size", "prefix").mapInArrow(_entries(often, bits), entry_schema), "jaccard-met")
    lead = spread(met.groupBy("gram").agg(F.min(F.struct("id", "a", "size", "pos")).alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    star = met.join(lead, "gram").filter("lead.id <> id").select(
        F.col("lead.id").alias("x"), F.col("id").alias("y"), F.col("lead.a").alias("xa"), F.col("a").alias("ya"), F.col("lead.size").alias("xs"), F.col("size").alias("ys"),
        F.col("lead.pos").alias("xp"), F.col("pos").alias("yp")).filter(_positional("xs", "xp", "ys", "yp", percent))
    tried, links = _links(rows, _filtered(star, heads, percent), n, percent, "jaccard-star")
    parts = settle(connected_components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))), "jaccard-parts")

    part = F.coalesce("component", "id")
    placed = met.select("gram", "id", "a", "size", "pos").join(parts, met["id"] == parts["node"], "left").select("gram", "id", "a", "size", "pos", part.alias("part"))
    open_ = spread(placed.groupBy("gram").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("gram"))
    rest = settle(placed.join(open_, "gram", "left_semi"), "jaccard-open")
    l, r = rest.alias("l"), rest.alias("r")
    across = l.join(r, F.expr(
        f"l.gram = r.gram and l.part <> r.part and l.id < r.id and 100 * least(l.size, r.size) >= {percent} * greatest(l.size, r.size)"
        f" and {_positional('l.size', 'l.pos', 'r.size', 'r.pos', percent)}")).select(
        F.col("l.id").alias("x"), F.col("r.id").alias("y"), F.col("l.a").alias("xa"), F.col("r.a").alias("ya"), F.col("l.size").alias("xs"), F.col("r.size").alias("ys"))
    left_over = _filtered(across, heads, percent).join(tried, ["x", "y"], "left_anti")
    _, more = _links(rows, left_over, n, percent, "jaccard-rest")

    edges = links.union(more).select(F.col("x").alias("u"), F.col("y").alias("v")).union(same_id.distinct())
    final = connected_components(edges)
    return sized.join(final, sized["doc_id"] == final["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of
    the least doc_id (nulls last, then the first in the table that is written
    here).  Rows are compared one by one, by their texts alone, so copies go
    whether their ids are null, repeated or different.  Rows without words are
    near duplicates of nothing, and stay."""
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    # the number of a row is fixed by the written table
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias("r"), "component_id")
    named = found.join(rows.select(F.col(row).alias("r"), F.col("doc_id").alias("id")), "r")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "r")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    extra = settle(named.join(spread(first), "component_id").filter("r <> first.r").select("r"), "jaccard-extra")
    return without(rows, row, extra).drop(row)
