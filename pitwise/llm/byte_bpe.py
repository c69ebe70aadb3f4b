"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is cut by the tokenizer's pattern; each piece is encoded by itself, as
the tiktoken library does: a piece that is a token is that token, else its
bytes are merged, the pair of least rank (the leftmost, if tied) first, until
no pair is a token.

- The distinct pieces of the corpus are counted, and the ``bound`` most
  frequent are folded once.  They are cut by Java's regular expressions, whose
  Unicode is older; a piece that the texts do not have is only never used.
- Arrow tasks cut the texts by the regex library; those without characters beyond U+FFFF
  by Python's own, which is faster, with the same pattern, whose classes are
  spelt out as the regex library has them.
- The merge is a fold over a piece's bytes.  Its state is the bounds of the
  parts: for each the rank of the two parts it divides (of nothing, at the
  ends) and its place, in one number, so the least is the leftmost pair of
  least rank.  A step takes one bound away and looks up the two beside it.
  Bytes are held as a string of code points 0-255.
- Ranks are a literal map, dealt by hash to an array of 2**16 small maps, since
  Spark searches a map from its start.  It enters the plan as a scalar
  subquery over one row.
- The folded words (at most ``bound``, each of at most ``FOLD`` bytes) are
  broadcast; a worker holds most of them as Arrow columns.  Texts are cut in Arrow tasks, which take their pieces' ids from
  them and hand on, in their places, the pieces that are not among them, which
  are folded there.  So no text, and no position, is shuffled, and nothing
  unbounded is broadcast; a piece's ids are the same either way.
- A fold of n bytes takes n**2 steps.  Pieces of over ``FOLD`` bytes are merged
  in the Arrow tasks instead, by the same rule over a heap of pairs: n log n.
- Decoding looks the ids up in an array of the tokens' bytes (as such strings) and concatenates.

Rows: null and empty texts have no tokens (both digests of nothing); repeated
rows are encoded one by one; only doc_id and text are read.  A piece of n bytes
needs some 60 n bytes of memory while it is merged, a text some 12 bytes for
each of its own.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.llm.tables import let, settle
from pitwise.llm.tokens import chunks

BOUND = 1 << 20
BUCKETS = 1 << 16
FOLD = 64        # bytes; longer pieces go through a heap
PLACES = 128     # places of a bound within such a piece, and more
NONE = 1 << 23   # above all ranks; a rank and a place fit 31 bits
LUMP = 1 << 16   # pieces of a text held at once
HOT = 1 << 18    # folded words that a worker holds in a dict


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _buckets(entries: DataFrame) -> DataFrame:
    """One row with an array of BUCKETS maps from entries (key, value)."""
    spark = entries.sparkSession
    lists = entries.groupBy(_bucket(F.col("key")).alias("b")).agg(F.collect_list(F.struct("key", "value")).alias("m"))
    filled = spark.range(BUCKETS).join(lists, F.col("id") == F.col("b"), "left").select("id", "m")
    return filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "m"))), lambda p: F.map_from_entries(p["m"])).alias("maps"))


def _find(maps: Column, key: Column) -> Column:
    return F.try_element_at(F.get(maps, _bucket(key)), key)


def _as_bytes(piece: Column) -> Column:
    """The UTF-8 bytes of a piece as code points 0-255."""
    return F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")


def _fold(data: Column, first: Column, later: Column) -> Column:
    """The tokens of a piece's bytes.  The two maps are one rank table, each
    column used once, so that the optimizer can put it in place."""
    place = lambda b: b.bitwiseAND(F.lit(PLACES - 1))
    ranked = lambda maps, key, at: F.coalesce(_find(maps, key), F.lit(NONE)) * PLACES + at
    n = F.length(data)
    end = lambda at: F.array(at + NONE * PLACES)
    bounds = F.concat(end(F.lit(1)), F.transform(F.sequence(F.lit(2), n), lambda at: ranked(first, F.substr(data, at - 1, F.lit(2)), at)), end(n + 1))

    def merge(acc: Column, p: Column) -> Column:
        """Takes the p-th bound away and ranks the two beside it anew; beyond
        the ends there is nothing to take, and so no rank."""
        def again(b: Column, k: Column) -> Column:
            lo, hi = place(F.get(acc, k - 1)), place(F.get(acc, k + 2))
            return let(F.substr(data, lo, hi - lo), lambda key: ranked(later, key, place(b)))
        return F.transform(F.array_remove(acc, F.get(acc, p - 1)), lambda b, k: F.when((k == p - 2) | (k == p - 1), again(b, k)).otherwise(b))

    def step(acc: Column, _: Column) -> Column:
        least = F.array_position(acc, F.array_min(acc)).cast("int")
        return let(least, lambda p: F.when(F.get(acc, p - 1) < NONE * PLACES, merge(acc, p)).otherwise(acc))

    def parts(acc: Column) -> Column:
        return F.transform(F.slice(acc, F.lit(1), F.size(acc) - 1), lambda b, k: F.substr(data, place(b), place(F.get(acc, k + 1)) - place(b)))

    folded = F.aggregate(F.sequence(F.lit(2), n), bounds, step, parts)
    return F.when(n > 1, folded).otherwise(F.array(data))


def heap_merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of a piece's bytes by a heap of the pairs that are tokens.
    An entry holds as long as the pair at its start still has its rank."""
    n = len(data)
    if data in ranks:
        return [ranks[data]]
    after, before, rank = array("q", range(1, n + 2)), array("q", range(-1, n)), array("q", [-1]) * n
    heap: list[int] = []

    def enter(i: int) -> None:
        j = after[i]
        rank[i] = ranks.get(data[i:after[j]], -1) if j < n else -1
        if rank[i] >= 0:
            heapq.heappush(heap, rank[i] * (n + 1) + i)

    for i in range(n - 1):
        enter(i)
    while heap:
        r, i = divmod(heapq.heappop(heap), n + 1)
        if rank[i] != r:
            continue
        j = after[i]
        rank[j] = -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        enter(i)
        if i > 0:
            enter(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i:after[i]]])
        i = after[i]
    return out


def _spelt(kind: str) -> str:
    """The characters up to U+FFFF of a class, as ranges of a set."""
    return "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(f"{kind}+", "".join(map(chr, range(1 << 16)))))


@cache
def spelt_out(pattern: str) -> re.Pattern | None:
    """A pattern of the regex library for Python's own, with its classes spelt
    out for characters up to U+FFFF; None if it has more than classes, sets,
    look-aheads, groups, escaped marks and repeats."""
    out, within = [], False
    for t in re.findall(r"\\p\{\w+\}|\\.|\(\?.|\(|.", pattern, re.DOTALL):
        if t.startswith("\\p{") or t == "\\s":
            out.append(_spelt(t) if within else f"[{_spelt(t)}]")
        elif t == "\\S" and not within:
            out.append(f"[^{_spelt(chr(92) + 's')}]")
        elif t in ("(?!", "(?=", "(?:") or t in ("\\r", "\\n", "\\t") or (t[0] == "\\" and not t[1].isalnum()):
            out.append(t)
        elif len(t) > 1 or t in ".^$" and not (within and t == "^") or within and t == "[":
            return None
        else:
            within = t == "[" or within and t != "]"
            out.append(t)
    return re.compile("".join(out))


class Cut:
    """Cuts texts by a pattern."""

    def __init__(self, pattern: str):
        self.any, self.near = regex.compile(pattern), spelt_out(pattern)

    def lumps(self, text: str | None) -> Iterator[list[str]]:
        near = text and self.near and len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return _lumps(self.near if near else self.any, text)


def _lumps(cut: regex.Pattern | re.Pattern, text: str | None) -> Iterator[list[str]]:
    """The pieces of a text, LUMP at once."""
    if text and len(text) <= LUMP and not cut.groups:
        yield cut.findall(text)
        return
    found = (m[0] for m in cut.finditer(text or ""))
    while lump := list(islice(found, LUMP)):
        yield lump


class Words:
    """Ids, joined by commas, of the folded words; read once by each worker.

    Some ``HOT`` words, the first and most frequent, are a dict.  The others are
    Arrow columns under the sorted hashes of their keys, some 50 bytes a word
    where a dict takes some 200; a found hash counts only if the key is equal,
    and the words of one hash are all in the dict."""

    def __init__(self, folded: pa.Table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, folded.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(folded)
        self._data, self._hot = sink.getvalue().to_pybytes(), None

    def __getstate__(self) -> dict:
        return {"_data": self._data, "_hot": None}

    def _load(self) -> None:
        self._hot, batches, hashes = {}, [], []
        for batch in pa.ipc.open_stream(self._data):
            keys = batch.column("key").to_pylist()
            if len(self._hot) < HOT:
                self._hot.update(zip(keys, batch.column("value").to_pylist(), strict=True))
            else:
                batches.append(batch)
                hashes.append(np.fromiter(map(hash, keys), np.int64, len(keys)))
        self._cold = pa.Table.from_batches(batches).combine_chunks() if batches else None
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        self._rows = np.argsort(every).astype(np.int32)
        self._hashes = every[self._rows]
        again = np.flatnonzero(self._hashes[1:] == self._hashes[:-1])
        if len(again):
            rows = self._cold.take(pa.array(self._rows[np.union1d(again, again + 1)]))
            self._hot.update(zip(rows["key"].to_pylist(), rows["value"].to_pylist(), strict=True))

    def ids(self, pieces: list[str]) -> tuple[list[str | None], list[int]]:
        """The ids of each piece that is a folded word, else None, and the
        places of those that are not."""
        if self._hot is None:
            self._load()
        found = list(map(self._hot.get, pieces))
        left = [i for i, x in enumerate(found) if x is None]
        if not left or not len(self._hashes):
            return found, left
        hashes = np.fromiter(map(hash, map(pieces.__getitem__, left)), np.int64, len(left))
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        same = np.flatnonzero(self._hashes[at] == hashes)
        if len(same):
            rows = self._cold.take(pa.array(self._rows[at[same]]))
            for j, key, value in zip(same.tolist(), rows["key"].to_pylist(), rows["value"].to_pylist(), strict=True):
                if pieces[left[j]] == key:
                    found[left[j]] = value
        return found, [i for i in left if found[i] is None]


def _groups(cut: Cut, texts: list[str | None]) -> Iterator[tuple[list[str], list[tuple[int, bool]]]]:
    """Pieces of consecutive texts, about LUMP at once, and the end of each
    text's share among them, with whether the text ends there."""
    pieces: list[str] = []
    ends: list[tuple[int, bool]] = []
    for text in texts:
        for lump in cut.lumps(text):
            if pieces and len(pieces) + len(lump) > LUMP:
                yield pieces, [*ends, (len(pieces), False)]
                pieces, ends = [], []
            pieces += lump
        ends.append((len(pieces), True))
    yield pieces, ends


def _parts(cut: Cut, texts: list[str | None], words: Words, known: Broadcast) -> tuple[list[int], list[str | None], list[str | None]]:
    """Where each text's parts begin, and all parts: the ids up to a piece that
    is to be folded, and that piece, if any."""
    offsets: list[int] = [0]
    before: list[str | None] = []
    rest: list[str | None] = []
    ready: list[str] = []
    for pieces, ends in _groups(cut, texts):
        found, left = words.ids(pieces)
        lo, j = 0, 0
        for hi, last in ends:
            while j < len(left) and left[j] < hi:
                i = left[j]
                j += 1
                data = pieces[i].encode()
                if len(data) > FOLD:
                    found[i] = ",".join(map(str, heap_merge(data, known.value)))
                    continue
                ready.append(",".join(found[lo:i]))
                before.append(",".join(filter(None, ready)) or None)
                rest.append(pieces[i])
                ready, lo = [], i + 1
            ready.append(",".join(found[lo:hi]))
            lo = hi
            if last:
                if ids := ",".join(filter(None, ready)):
                    before.append(ids)
                    rest.append(None)
                ready = []
                offsets.append(len(rest))
    return offsets, before, rest


class Tokenizer:
    """Rank and byte tables of one file of ranks, as one-row tables."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        known = read_ranks(path)
        if any(r >= NONE for _, r in known):
            raise ValueError(f"ranks must be below {NONE}")
        self.pattern = pattern
        self.known = spark.sparkContext.broadcast(dict(known))
        rows = spark.createDataFrame([(t.decode("latin-1"), r) for t, r in known], "key string, value int")
        self.ranks = settle(_buckets(rows), "bpe-ranks")
        places = spark.range(max(r for _, r in known) + 1).join(rows, F.col("id") == F.col("value"), "left")
        self.tokens = settle(places.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("key", F.lit("")).alias("key")))), lambda x: x["key"]).alias("keys")), "bpe-tokens")

    def _tables(self) -> list[Column]:
        return [self.ranks.scalar().alias(f"_r{i}") for i in range(4)]

    @staticmethod
    def _ids(piece: Column) -> Column:
        """A piece's ids, joined by commas; _r0 to _r3 must be in the row."""
        return let(_as_bytes(piece), lambda data: F.coalesce(
            _find(F.col("_r0"), data).cast("string"),
            F.array_join(F.transform(_fold(data, F.col("_r1"), F.col("_r2")), lambda x: _find(F.col("_r3"), x).cast("string")), ",")))

    def counted(self, docs: DataFrame) -> DataFrame:
        """key, n: the pieces of all texts, of at most FOLD bytes, and their counts."""
        cut = F.lit("(?U)" + self.pattern)  # white space as in Unicode
        pieces = docs.select(F.explode(F.regexp_extract_all(F.col("text").cast("string"), cut, F.lit(0))).alias("key"))
        return pieces.filter(F.octet_length("key") <= FOLD).groupBy("key").agg(F.count("*").alias("n"))

    def words(self, docs: DataFrame, bound: int) -> Words:
        """The most frequent pieces, ``bound`` at most, and their ids."""
        often = settle(self.counted(docs).filter("n > 1"), "bpe-words")
        # frequency classes of a sixteenth of a doubling: at most some thousand rows
        steps = often.groupBy(F.floor(16 * F.log2("n")).alias("class")).agg(F.count("*").alias("words")).orderBy(F.col("class").desc()).collect()
        least, total = None, 0
        for row in steps:
            total += row["words"]
            if total > bound:
                break
            least = row["class"]
        if least is None:
            return Words(pa.table({"key": pa.array([], pa.string()), "value": pa.array([], pa.string())}))
        chosen = often.filter(F.floor(16 * F.log2("n")) >= least)
        encoded = chosen.repartition("key").select("key", "n", *self._tables()).select("key", "n", self._ids(F.col("key")).alias("value"))
        return Words(settle(encoded, "bpe-table").orderBy(F.col("n").desc(), "key").select("key", "value").toArrow())

    def looked_up(self, docs: DataFrame, words: Words) -> DataFrame:
        """doc_id, parts: the ids of a text (joined by commas) up to a piece
        that is to be folded, and that piece, if any."""
        pattern, known, table = self.pattern, self.known, docs.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut = Cut(pattern)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for lo, hi in chunks(texts):
                    offsets, before, rest = _parts(cut, texts[lo:hi], table.value, known)
                    parts = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(rest, pa.string())], ["ids", "rest"])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)], ["doc_id", "parts"])

        schema = T.StructType([
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("parts", T.ArrayType(T.StructType([T.StructField("ids", T.StringType()), T.StructField("rest", T.StringType())])))])
        return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

    def encode(self, docs: DataFrame, bound: int = BOUND) -> DataFrame:
        """Per row of docs: doc_id, ids (decimal, joined by commas), n_tokens."""
        rows = self.looked_up(docs, self.words(docs, bound)).select("*", *self._tables())
        ids = F.transform("parts", lambda p: F.concat_ws(",", p["ids"], F.when(p["rest"].isNotNull(), self._ids(p["rest"]))))
        rows = rows.select("doc_id", F.array_join(ids, ",").alias("ids"))
        n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(","), F.lit(""))) + 1)
        return rows.select("doc_id", "ids", n.cast("long").alias("n_tokens"))

    def decode(self, encoded: DataFrame) -> DataFrame:
        """encoded with a binary column decoded: the bytes of its ids."""
        rows = encoded.withColumn("_keys", self.tokens.scalar())
        keys = F.transform(F.split("ids", ","), lambda x: F.get(F.col("_keys"), x.try_cast("int")))
        return rows.withColumn("decoded", F.encode(F.array_join(keys, ""), "ISO-8859-1")).drop("_keys")
