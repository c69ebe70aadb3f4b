"""MinHash near-dedup by min-max hashing: every permutation is evaluated once
per shingle and gives two signature values, its minimum and its maximum.

A document's set is its distinct word n-grams (A-Z lower-cased; with fewer
words the whole sequence).  Two documents link when
100 * |x & y| >= percent * |x | y|.

1. Classes: documents with equal sets (a 128-bit digest and the size) are one
   class, whose least doc_id stands for it.  Copies need no pairs.
2. Signatures: the minimum and the maximum each agree with probability J, and
   rarely agree by chance together, so the share of agreeing values is an
   unbiased estimate of J of lower variance than that of as many minima.
   A band is ``rows`` minima, or ``rows`` maxima, of different permutations.
   The number of bands follows from ``miss``: a pair that just links shares
   no band with at most that probability (1e-11).
3. Stars: per bucket only its leader is paired with the members that are not
   yet in its component, so a group of thousands of near copies costs one pair
   for each member, not all pairs.  After the first star (leader: least id)
   components are taken and a second star tries other leaders (by hash).
4. Rest: buckets whose members are still in different components give their
   pairs across components, less those tried before, so no link between
   components is lost; links within one would change nothing.  A pair is
   given in the first of its common bands only.  A shingle that only one of
   these members has is in no common part, so the others bound what the
   member can share with any: members and pairs below the bound go out,
   exactly, and so do members that fall below it when those are gone.  Each
   member also has a map of MARKS bits of its shingles' hashes: a bit that only
   one of two members has stands for a shingle, or more, that they do not
   share, so pairs that cannot link by it go out within the join, exactly too.
5. Each pair is tested by size and by one bit of each signature value (linked
   sets differ in more bits with probability 1e-12 at most), in step 4 within
   the join, and then confirmed once on the full sets of both whole texts.

Rows: null and empty texts, or texts without words, have an empty set and link
with nothing; rows with one doc_id are one document of the graph, which links
by any of its sets; rows without doc_id keep their set size, a null component
and are kept.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.llm.components import connected_components
from pitwise.llm.tables import settle, spread
from pitwise.llm.tokens import Words, chunks, mix

SKETCH = 8               # 64-bit words of signature bits
BLOCK = 1 << 15          # shingles whose permutations are taken at once
FILTER_BITS = 24
MARKS = 1024             # bits of a member's map of shingles


@dataclass(frozen=True)
class Banding:
    """bands (even: half of minima, half of maxima) of rows values each;
    limit: at most so many signature bits differ between linked sets."""

    rows: int
    bands: int
    limit: int

    @property
    def permutations(self) -> int:
        return self.rows * self.bands // 2

    @property
    def bits(self) -> int:
        return min(64 * SKETCH, 2 * self.permutations)


def banding(percent: int, miss: float = 1e-11, unlike: float = 1e-12) -> Banding:
    """Rows (16 at most) so that a band of a pair that just links agrees about
    once in four; bands by miss; the bit limit by the binomial tail unlike."""
    j = percent / 100
    if j >= 1:
        return Banding(1, 0, 0)
    rows = min(16, max(1, round(math.log(0.26) / math.log(j))))
    half = math.ceil(math.log(miss) / math.log(1 - j**rows) / 2)
    plan = Banding(rows, 2 * half, 0)
    m, p = plan.bits, (1 - j) / 2
    tail, k = 0.0, m
    while k > 0:
        tail += math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + (m - k) * math.log1p(-p))
        if tail > unlike:
            break
        k -= 1
    return Banding(rows, 2 * half, k)


def _constants(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def sets_of(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi], "space", True)
        i = np.arange(len(w.start))
        size = np.minimum(n, w.count[w.doc])
        p = i[i + size <= w.stop]
        h, bounds = w.runs(p, p + size[p]), np.searchsorted(w.doc[p], np.arange(hi - lo + 1))
        for k in range(hi - lo):
            yield np.unique(h[bounds[k]:bounds[k + 1]])


def signatures(sets: list[np.ndarray], permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """(minima, maxima) of nonempty sets, one row each and one column per permutation."""
    factor, add = _constants(permutations, 17), _constants(permutations, 29)
    low, high = (np.empty((len(sets), permutations), np.uint64) for _ in range(2))
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= BLOCK):
            size += len(sets[hi])
            hi += 1
        u = np.concatenate(sets[lo:hi])
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets[lo:hi - 1]], dtype=np.int64)))
        v = np.empty_like(u)
        for k in range(permutations):
            np.multiply(u, factor[k], out=v)
            v += add[k]
            low[lo:hi, k] = np.minimum.reduceat(v, at)
            high[lo:hi, k] = np.maximum.reduceat(v, at)
        lo = hi
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, plan: Banding) -> np.ndarray:
    weight, half = _constants(plan.rows, 43), plan.bands // 2
    keys = [(mix(s.reshape(len(s), half, plan.rows)) * weight).sum(2, dtype=np.uint64) for s in (low, high)]
    return mix(np.concatenate(keys, 1) + _constants(plan.bands, 71)).view(np.int64)


def sketches(low: np.ndarray, high: np.ndarray, plan: Banding) -> np.ndarray:
    """One bit of each signature value, as SKETCH words."""
    bits = ((np.concatenate((low, high), 1)[:, :plan.bits] >> np.uint64(21)) & np.uint64(1)).astype(np.uint8)
    packed = np.zeros((len(bits), 8 * SKETCH), np.uint8)
    packed[:, : (bits.shape[1] + 7) // 8] = np.packbits(bits, axis=1)
    return packed.view(np.int64)


def _profile(n: int, percent: int, plan: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                sets = list(sets_of(batch.column("text").to_pylist(), n))
                size = np.array([len(u) for u in sets], np.int64)
                digest = np.zeros((len(sets), 2), np.int64)
                for k, u in enumerate(sets):
                    if len(u):
                        digest[k] = np.frombuffer(hashlib.md5(u.tobytes()).digest(), np.int64)
                # a set of m shingles meets another one with at best m in common of m + 1
                able = np.flatnonzero((size > 0) & (100 * size >= percent * (size + 1)) & (plan.bands > 0))
                offsets, keys, bits = np.zeros(len(sets) + 1, np.int32), np.empty(0, np.int64), np.zeros((len(sets), SKETCH), np.int64)
                if len(able):
                    low, high = signatures([sets[k] for k in able], plan.permutations)
                    keys, bits[able] = band_keys(low, high, plan).ravel(), sketches(low, high, plan)
                    offsets[able + 1] = plan.bands
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.arange(row, row + len(sets))), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), bands,
                     *(pa.array(bits[:, i]) for i in range(SKETCH))],
                    ["doc_id", "row", "n", "a", "b", "bands", *(f"s{i}" for i in range(SKETCH))])
                row += len(sets)

    return run


def _confirm(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x_texts, y_texts = part.column("x_text").to_pylist(), part.column("y_text").to_pylist()
                once = list(dict.fromkeys([*x_texts, *y_texts]))
                sets, ok = dict(zip(once, sets_of(once, n), strict=True)), []
                for x, y in zip(x_texts, y_texts, strict=True):
                    x, y = sets[x], sets[y]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return run


def _marked(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            keep = (bitmap[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep))

    return run


def _texts_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, text of the documents in pairs.  A bitmap of 2**24 bits, which
    Spark folds to 2**18 words, keeps most other texts out of the shuffle; the
    semi-join is exact."""
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    low = F.xxhash64("id").bitwiseAND((1 << FILTER_BITS) - 1)
    words = ids.select(low.alias("h")).groupBy((F.shiftright("h", 6)).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros((1 << FILTER_BITS) // 64, np.uint64)
    bitmap[words["w"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    hashed = rows.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").bitwiseAND((1 << FILTER_BITS) - 1).alias("h"))
    near = hashed.mapInArrow(_marked(bitmap), T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))
    return near.join(ids, near["doc_id"] == ids["id"], "left_semi")


def _alike_sizes(x: str, y: str, percent: int) -> Column:
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")


def _differing(x: str, y: str) -> Column:
    return F.expr(" + ".join(f"bit_count({x}s{i} ^ {y}s{i})" for i in range(SKETCH)))


def _first_common(key: str, x: str, y: str) -> Column:
    """Whether key is the first band key that x and y share."""
    return F.expr(f"get(filter(zip_with({x}, {y}, (p, q) -> if(p = q, p, null)), p -> p is not null), 0) = {key}")


def _alike(pairs: DataFrame, heads: DataFrame, plan: Banding) -> DataFrame:
    """(x, y) of the pairs x, xa, y, ya whose sketches are alike."""
    bits = lambda side: heads.select(F.col("id").alias(side), F.col("a").alias(f"{side}a"), *(F.col(f"s{i}").alias(f"{side}s{i}") for i in range(SKETCH)))
    both = pairs.distinct().join(bits("x"), ["x", "xa"]).join(bits("y"), ["y", "ya"])
    return both.filter(_differing("x", "y") <= plan.limit).select("x", "y").distinct()


def _confirmed(rows: DataFrame, pairs: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    texts = settle(_texts_of(rows, pairs), f"{name}-texts")
    sides = pairs.join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("y_text")), "y").join(
        texts.select(F.col("doc_id").alias("x"), F.col("text").alias("x_text")), "x").select("x", "y", "x_text", "y_text")
    return settle(sides.mapInArrow(_confirm(n, percent), T.StructType([pairs.schema["x"], pairs.schema["y"]])).distinct(), f"{name}-links")


def marks(u: np.ndarray) -> np.ndarray:
    """A set's map of MARKS bits, as 64-bit words."""
    bits = np.zeros(MARKS, np.uint8)
    bits[((u >> np.uint64(32)) & np.uint64(MARKS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _shared_at_most(x: str, y: str) -> str:
    """A bound of how many shingles two members share: a set's size, less the
    bits of its map that the other one lacks."""
    lacks = lambda p, q: " + ".join(f"bit_count({p}m{i} & ~{q}m{i})" for i in range(MARKS // 64))
    return f"least({x}size - ({lacks(x, y)}), {y}size - ({lacks(y, x)}))"


def _grams(n: int):
    """Per text its id, its set's digest, its set and the map of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                sets = list(sets_of(batch.column("text").to_pylist(), n))
                a = [int(np.frombuffer(hashlib.md5(u.tobytes()).digest(), np.int64)[0]) for u in sets]
                offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))
                maps = np.array([marks(u) for u in sets], np.int64).reshape(len(sets), MARKS // 64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(a, pa.int64()), grams, *(pa.array(maps[:, i]) for i in range(MARKS // 64))],
                    ["id", "a", "grams", *(f"m{i}" for i in range(MARKS // 64))])

    return run


def _shareable(rows: DataFrame, members: DataFrame, n: int, percent: int, rounds: int = 2) -> DataFrame:
    """id, a, most and the map's words m0, m1 ...: the members that can link, and how many of their shingles another member has."""
    texts = _texts_of(rows, members.select(F.col("id").alias("x"), F.col("id").alias("y")))
    schema = T.StructType([T.StructField("id", rows.schema["doc_id"].dataType), T.StructField("a", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType())),
                           *(T.StructField(f"m{i}", T.LongType()) for i in range(MARKS // 64))])
    # rows that repeat one id and text would hide what is theirs alone
    sets = texts.select("doc_id", "text").distinct().mapInArrow(_grams(n), schema).join(members, ["id", "a"], "left_semi")
    sets = settle(sets, "minhash-sets")
    for _ in range(rounds):
        owners = sets.select(F.struct("id", "a").alias("m"), F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("m").alias("m"), F.max("m").alias("o"))
        alone = owners.filter("m = o").groupBy("m").agg(F.count("*").alias("alone")).select("m.id", "m.a", "alone")
        most = (F.size("grams") - F.coalesce("alone", F.lit(0))).cast("int")
        sets = settle(sets.drop("most").join(spread(alone), ["id", "a"], "left").withColumn("most", most).drop("alone").filter(
            F.expr(f"100 * most >= {percent} * size(grams)")), "minhash-sets")
    return sets.drop("grams")


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("u"), F.col("y").alias("v"))


def _open(entries: DataFrame, edges: DataFrame | None, name: str) -> DataFrame:
    """Entries of the buckets whose members are in different components."""
    if edges is not None:
        parts = settle(connected_components(edges), f"{name}-parts")
        entries = entries.drop("part").join(spread(parts.withColumnRenamed("node", "id")), "id", "left").select(
            "key", "id", "a", "size", F.coalesce("component", "id").alias("part"))
    apart = entries.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("key")
    return settle(entries.join(spread(apart), "key", "left_semi"), f"{name}-open")


def _star(entries: DataFrame, order: Column, percent: int) -> DataFrame:
    """Pairs of each bucket's leader, the least by order, with its members of other components."""
    lead = entries.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "a", "size", "part")).alias("l")).select(
        "key", F.col("l.id").alias("li"), F.col("l.a").alias("la"), F.col("l.size").alias("ls"), F.col("l.part").alias("lp"))
    met = entries.join(spread(lead), "key").filter(F.col("lp") != F.col("part")).filter(_alike_sizes("ls", "size", percent))
    first = F.col("li") < F.col("id")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return met.select(pick("li", "id").alias("x"), pick("id", "li").alias("y"), pick("la", "a").alias("xa"), pick("a", "la").alias("ya"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, miss: float = 1e-11) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (its set's size), component_id (the
    least doc_id reachable by links, itself included), kept (doc_id is it)."""
    if not 0 < percent <= 100 or n < 1 or not 0 < miss < 1:
        raise ValueError("n must be at least 1, percent within 1..100 and miss between 0 and 1")
    plan = banding(percent, miss)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    profile_schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), *longs("row", "n", "a", "b"), T.StructField("bands", T.ArrayType(T.LongType())),
        *longs(*(f"s{i}" for i in range(SKETCH)))])
    profile = settle(rows.mapInArrow(_profile(n, percent, plan), profile_schema), "minhash-profile")

    sized = profile.select("doc_id", F.col("n").alias("n_shingles"), "a", "b")
    first = profile.filter("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min(F.struct("doc_id", "row")).alias("f"))
    classes = settle(first.select(F.col("n").alias("n_shingles"), "a", "b", F.col("f.doc_id").alias("id"), F.col("f.row").alias("row")), "minhash-classes")
    placed = settle(sized.join(spread(classes.drop("row")), ["n_shingles", "a", "b"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("id")), "minhash-placed")
    # rows of one doc_id are one document: its classes are linked from the start
    several = placed.filter("id is not null").groupBy("doc_id").agg(F.min("id").alias("p"), F.max("id").alias("q")).filter("p <> q").select("doc_id")
    edges = settle(placed.join(spread(several), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("id").alias("v")).distinct(), "minhash-same")

    heads = settle(profile.join(classes.select("row"), "row", "left_semi").filter(F.size("bands") > 0).select(
        F.col("doc_id").alias("id"), "a", F.col("n").cast("int").alias("size"), "bands", *(f"s{i}" for i in range(SKETCH))), "minhash-heads")
    entries = heads.select(F.explode("bands").alias("key"), "id", "a", "size")
    # counts alone are shuffled for every entry; then only those that meet another set
    shared = entries.groupBy("key").agg(F.min("a").alias("p"), F.max("a").alias("q")).filter("p <> q").select("key")
    met = settle(entries.join(spread(shared), "key", "left_semi").withColumn("part", F.col("id")), "minhash-met")

    tried = None
    for name, order in (("minhash-least", F.col("id")), ("minhash-hashed", F.xxhash64("id", "key"))):
        if tried is not None:
            met = _open(met, edges, name)
        pairs = _alike(_star(met, order, percent), heads, plan)
        pairs = settle(pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti"), f"{name}-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        edges = edges.union(_edges(_confirmed(rows, pairs, n, percent, name)))

    rest = _open(met, edges, "minhash-rest")
    able = _shareable(rows, settle(rest.select("id", "a").distinct(), "minhash-members"), n, percent)
    rest = settle(rest.join(able, ["id", "a"]).join(heads.drop("size"), ["id", "a"]), "minhash-rest")
    l, r = rest.alias("l"), rest.alias("r")
    enough = F.expr(f"100 * least(l.most, r.most) >= {percent} * (l.size + r.size - least(l.most, r.most))")
    marked = F.expr(f"{100 + percent} * {_shared_at_most('l.', 'r.')} >= {percent} * (l.size + r.size)")
    across = l.join(r, F.expr("l.key = r.key and l.part <> r.part and l.id < r.id") & _alike_sizes("l.size", "r.size", percent) & enough & (
        _differing("l.", "r.") <= plan.limit) & marked & _first_common("l.key", "l.bands", "r.bands"))
    pairs = settle(across.select(F.col("l.id").alias("x"), F.col("r.id").alias("y")).distinct().join(tried, ["x", "y"], "left_anti"), "minhash-rest-pairs")
    edges = edges.union(_edges(_confirmed(rows, pairs, n, percent, "minhash-rest")))

    found = connected_components(edges)
    return placed.join(spread(found.withColumnRenamed("node", "id")), "id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))
