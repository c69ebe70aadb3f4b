"""Phrase collocation mining over weighted acyclic automata.

Texts (A-Z lower-cased) are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those
at blanks and tabs into words.  A window is the up to four words from a word
on, within its piece; a phrase's count is the number of windows it begins.

1. Shards: every task collects the windows of at most ``SHARD`` words per
   language, sorts them, and builds count transducers from the sorted windows:
   arcs carry a word and the count of the phrase read so far, states with the
   same continuations are one state (built from the last word backwards, so a
   state's targets are already shared).
2. Prefix ranges: the transducers are cut at boundaries that are quantiles of
   a bounded sample of windows (up to 2**18; it only balances the work).  A
   range is united in one task: its transducers are read out, their words
   renumbered, equal windows added up.  Of each range the phrases with enough
   windows go on, and the first and last phrase of each length, which it may
   share with its neighbours; a sum over ranges makes all counts exact.
3. Part look-ups: transducers of the frequent phrases are built per prefix
   range and composed with the parts asked for in that range (all parts of a
   frequent phrase are frequent).
4. Scores, containment and ranks are joins and aggregates; a language's ranks
   come from its best rows of every slice.

Rows: null and empty texts have no words; a null lang is ``und``; doc ids are
not read, repeated rows count again; an empty table gives an empty result.  A
text of any length is read in segments of ``SEGMENT`` bytes, cut between words.
Only text and lang are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.llm.tables import settle, spread
from pitwise.llm.tokens import mix

LENGTH = 4                 # words of a window
SHARD = 2 << 20            # words of a language collected before they are sorted
SEGMENT = 1 << 18          # bytes of a text split at once
RANGE = 2 << 20            # windows of a prefix range, about
MOST_RANGES = 1 << 16
SAMPLES = 1 << 18
BREAK = b"\xff"            # no byte of UTF-8

_TABLE = bytearray(range(256))
_TABLE[0x41:0x5B] = _TABLE[0x61:0x7B]
_TABLE[0x09] = 0x20
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0xFF
_TABLE = bytes(_TABLE)

Boundary = tuple[bytes, ...]   # language and LENGTH words, b"" after the last


def segments(text: str) -> Iterator[list[bytes]]:
    """The text's words, BREAK between pieces, in segments."""
    data, lo = text.encode("utf-8", "surrogatepass").translate(_TABLE), 0
    while lo < len(data):
        hi = lo + SEGMENT
        if hi < len(data):
            cut = max(data.rfind(b" ", lo, hi), data.rfind(BREAK, lo, hi))
            if cut < lo:
                ends = [x for x in (data.find(b" ", hi), data.find(BREAK, hi)) if x >= 0]
                cut = min(ends, default=len(data))
            hi = cut + 1
        yield data[lo:hi].replace(BREAK, b" \xff ").split()
        lo = hi


# ------------------------------------------------------------ transducers

def _bits(n_words: int) -> int:
    return max(1, int(n_words).bit_length())


def _sorted_sums(w: np.ndarray, weight: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of w in order, and the sums of their weights."""
    if not len(w):
        return w, weight
    b = _bits(n_words)
    if LENGTH * b <= 64:
        key = _packed(w, b)
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
    else:
        order = np.lexsort(w.T[::-1])
        new = np.concatenate(([True], (np.diff(w[order], axis=0) != 0).any(1)))
    at = np.flatnonzero(new)
    return w[order[at]], np.add.reduceat(weight[order], at)


def _packed(w: np.ndarray, b: int) -> np.ndarray:
    key = w[:, 0].astype(np.uint64)
    for k in range(1, LENGTH):
        key = (key << np.uint64(b)) | w[:, k].astype(np.uint64)
    return key


def _starts(w: np.ndarray, k: int) -> np.ndarray:
    """First row of each run of sorted rows that agree in k words."""
    if k == 0:
        return np.zeros(min(1, len(w)), np.int64)
    return np.flatnonzero(np.concatenate(([True], (w[1:, :k] != w[:-1, :k]).any(1)))) if len(w) else np.empty(0, np.int64)


class Transducer:
    """words: the sorted lexicon; the words of arcs are numbered from 1.  State
    s has the arcs first[s]:first[s + 1], by label; state 0 has none; start is
    the state where phrases begin.  count[arc] is the weight of a phrase whose
    last arc it is."""

    def __init__(self, words: list[bytes], first: np.ndarray, label: np.ndarray, count: np.ndarray, target: np.ndarray, start: int):
        self.words, self.first, self.label, self.count, self.target, self.start = words, first, label, count, target, start

    @classmethod
    def of_windows(cls, words: list[bytes], w: np.ndarray, weight: np.ndarray) -> "Transducer":
        """From distinct sorted windows: an arc counts the windows through it."""
        return cls._build(words, w, lambda at, _: np.add.reduceat(weight, at))

    @classmethod
    def of_phrases(cls, words: list[bytes], w: np.ndarray, count: np.ndarray) -> "Transducer":
        """From distinct sorted phrases: an arc has the count of its phrase, or
        0 where the phrase read so far is not among them."""
        size = (w != 0).sum(1)
        return cls._build(words, w, lambda at, k: np.where(size[at] == k, count[at], 0))

    @classmethod
    def _build(cls, words, w, arc_counts) -> "Transducer":
        degrees, labels, counts, targets = [np.zeros(1, np.int64)], [], [], []
        states, below, below_state = 1, np.empty(0, np.int64), np.empty(0, np.int64)
        for k in range(LENGTH, 0, -1):
            at = _starts(w, k)                       # phrases of k words; shorter windows have label 0
            target = np.zeros(len(at), np.int64)
            if len(below):                           # states reached, of those that continue
                target[np.searchsorted(at, below, "right") - 1] = below_state
            label, count = w[at, k - 1].astype(np.int64), arc_counts(at, k)
            real = label != 0
            label, count, target, at = label[real], count[real], target[real], at[real]
            parents = _starts(w, k - 1)
            parent = np.searchsorted(parents, at, "right") - 1
            own, begin, degree = np.unique(parent, return_index=True, return_counts=True)
            # equal lists of arcs are one state: two hashes of each list
            keys = []
            for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
                h = mix(mix(mix(label.astype(np.uint64) + salt) ^ count.astype(np.uint64)) ^ target.astype(np.uint64))
                keys.append(np.add.reduceat(h, begin) if len(begin) else h)
            order = np.lexsort(keys)
            new = np.concatenate(([True], (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1]))) if len(order) else np.empty(0, bool)
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            kept = order[new]
            pick = _expand(begin[kept], degree[kept])
            degrees.append(degree[kept])
            labels.append(label[pick])
            counts.append(count[pick])
            targets.append(target[pick])
            below, below_state = parents[own], number + states
            states += len(kept)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        first = np.concatenate(([0], np.cumsum(np.concatenate(degrees))))
        return cls(words, first, join(labels), join(counts), join(targets), int(below_state[0]) if len(below_state) else 0)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of word numbers (0 after the last) and the weights that end there."""
        rows, weights = [], []
        prefix, state, through = np.zeros((1, LENGTH), np.int32), np.array([self.start]), np.zeros(1, np.int64)
        for k in range(LENGTH + 1):
            degree = self.first[state + 1] - self.first[state]
            arc, parent = _expand(self.first[state], degree), np.repeat(np.arange(len(state)), degree)
            left = through - np.bincount(parent, self.count[arc], len(state)).astype(np.int64) if k else np.zeros(1, np.int64)
            rows.append(prefix[left > 0])
            weights.append(left[left > 0])
            if k == LENGTH or not len(arc):
                break
            prefix, state, through = prefix[parent], self.target[arc], self.count[arc]
            prefix[:, k] = self.label[arc]
        return np.concatenate(rows), np.concatenate(weights)

    def compose(self, phrases: list[list[bytes]]) -> np.ndarray:
        """The counts of phrases (0: none): their arcs and this transducer's
        are followed together, word by word."""
        out = np.zeros(len(phrases), np.int64)
        if not len(self.label):
            return out
        index = {x: k + 1 for k, x in enumerate(self.words)}
        size = np.array([len(p) for p in phrases], np.int64)
        state, live, wide = np.full(len(phrases), self.start), np.arange(len(phrases)), len(self.words) + 1
        arcs = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * wide + self.label
        for k in range(LENGTH):
            live = live[size[live] > k]
            if not len(live):
                break
            label = np.array([index.get(phrases[p][k], 0) for p in live], np.int64)
            key = state[live] * wide + label
            at = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            met = (arcs[at] == key) & (label > 0)
            live, at = live[met], at[met]
            state[live] = self.target[at]
            last = size[live] == k + 1
            out[live[last]] = self.count[at[last]]
        return out

    def to_bytes(self) -> bytes:
        head, body = [len(self.words), self.start], []
        arrays = (np.frombuffer(b"\xff".join(self.words), np.uint8), np.diff(self.first), self.label, self.count, self.target)
        for x in arrays:
            top = int(x.max(initial=0))
            x = x.astype(np.min_scalar_type(top))
            head += [x.dtype.itemsize, len(x)]
            body.append(x.tobytes())
        raw = np.array(head, "<i8").tobytes() + b"".join(body)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @classmethod
    def from_bytes(cls, data: bytes) -> "Transducer":
        raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
        head, at, arrays = np.frombuffer(raw, "<i8", 12), 96, []
        for size, n in head[2:].reshape(-1, 2):
            arrays.append(np.frombuffer(raw, f"<u{size}", n, at))
            at += int(size * n)
        words = arrays[0].tobytes().split(b"\xff") if head[0] else []
        degree, label, count, target = (x.astype(np.int64) for x in arrays[1:])
        return cls(words, np.concatenate(([0], np.cumsum(degree))), label, count, target, int(head[1]))


def _expand(first: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + degree[i] - 1 of every i, in order."""
    total = int(degree.sum())
    return np.repeat(first - np.cumsum(degree) + degree, degree) + np.arange(total)


def _renumbered(words: list[bytes], w: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Only the words that occur in w."""
    used = np.zeros(len(words) + 1, bool)
    used[w] = True
    used[0] = False
    number = np.cumsum(used)
    number[~used] = 0
    return [words[k - 1] for k in np.flatnonzero(used)], number[w].astype(np.int32)


def united(parts: list[Transducer]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lexicon, distinct sorted windows and summed weights of all parts."""
    words = sorted(set(chain.from_iterable(p.words for p in parts)))
    index = {x: k + 1 for k, x in enumerate(words)}
    rows, weights = [], []
    for p in parts:
        w, weight = p.windows()
        number = np.zeros(len(p.words) + 1, np.int32)
        number[1:] = [index[x] for x in p.words]
        rows.append(number[w])
        weights.append(weight)
    return words, *_sorted_sums(np.concatenate(rows), np.concatenate(weights), len(words))


# ------------------------------------------------------------ shards

class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Stream:
    """The words of one language, waiting to be sorted."""

    def __init__(self):
        self.number, self.parts, self.size = _Numbers({BREAK: 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        if words:
            self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            self.size += len(words)

    def take(self, final: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Lexicon, sorted windows and counts.  Unless final, the windows of
        the last words wait for the words to come."""
        t = np.concatenate([*self.parts, np.zeros(LENGTH, np.int32)])
        words = sorted(x for x in self.number if x != BREAK)
        rank = np.zeros(len(self.number), np.int32)
        rank[[self.number[x] for x in words]] = np.arange(1, len(words) + 1)
        stop = self.size if final else max(0, self.size - LENGTH + 1)
        held = [x for x in self._read(t[stop:self.size])]
        t = rank[t]
        p = np.flatnonzero(t[:stop])
        w = np.zeros((len(p), LENGTH), np.int32)
        w[:, 0] = t[p]
        for k in range(1, LENGTH):
            w[:, k] = np.where(w[:, k - 1] != 0, t[p + k], 0)
        self.__init__()
        self.add(held)
        return words, *_sorted_sums(w, np.ones(len(w), np.int64), len(words))

    def _read(self, t: np.ndarray) -> Iterator[bytes]:
        back = {int(n): None for n in t}
        for x, n in self.number.items():
            if n in back:
                back[n] = x
        return (back[int(n)] for n in t)


def _cuts(words: list[bytes], w: np.ndarray, boundaries: list[Boundary]) -> np.ndarray:
    """For each boundary the first window that isn't before it."""
    if not boundaries:
        return np.empty(0, np.int64)
    rows = np.zeros((len(boundaries), LENGTH), np.int32)
    for i, (_, *parts) in enumerate(boundaries):
        for k, x in enumerate(parts):
            if not x:
                break
            n = bisect_left(words, x)
            rows[i, k] = n + 1
            if n == len(words) or words[n] != x:
                break
    b = _bits(len(words) + 1)
    if LENGTH * b <= 64:
        return np.searchsorted(_packed(w, b), _packed(rows, b), "left")
    wide = lambda x: np.ascontiguousarray(x.astype(">u4")).view(f"S{4 * LENGTH}").ravel()
    return np.searchsorted(wide(w), wide(rows), "left")


def _shards(boundaries: list[Boundary]):
    """Transducers (range, lang, data) of the windows of a task's texts."""
    langs = [b[0] for b in boundaries]

    def emit(lang: str, stream: _Stream, final: bool) -> Iterator[pa.RecordBatch]:
        words, w, weight = stream.take(final)
        name = lang.encode()
        lo, hi = bisect_left(langs, name), bisect_left(langs, name + b"\x00")
        at = np.concatenate(([0], _cuts(words, w, boundaries[lo:hi]), [len(w)]))
        for k in np.flatnonzero(np.diff(at) > 0):
            part = slice(int(at[k]), int(at[k + 1]))
            data = Transducer.of_windows(*_renumbered(words, w[part]), weight[part]).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([lo + int(k)], pa.int32()), pa.array([lang]), pa.array([data], pa.binary())], ["range", "lang", "data"])

    def run(batches):
        streams: dict[str, _Stream] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                if not (t := text.as_py()):
                    continue
                lang = lang.as_py()
                s = streams.setdefault(lang, _Stream())
                for words in segments(t):
                    s.add(words)
                    if s.size >= SHARD:
                        yield from emit(lang, s, False)
                s.add([BREAK])
            if sum(s.size for s in streams.values()) >= 2 * SHARD:
                for lang, s in streams.items():
                    yield from emit(lang, s, False)
        for lang, s in streams.items():
            yield from emit(lang, s, True)

    return run


# ------------------------------------------------------------ prefix ranges

def _sampled(step: int):
    """A window about every step bytes (lang, window: words joined by blanks)."""

    def run(batches):
        for batch in batches:
            langs, windows = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                for at in range(zlib.crc32(data) % step, len(data), step):
                    words = data[at:at + 256].translate(_TABLE).replace(BREAK, b" \xff ").split()[1:]
                    while words and words[0] == BREAK:
                        words.pop(0)
                    if len(words) > 1:
                        words = words[:LENGTH]
                        langs.append(lang)
                        windows.append(b" ".join(words[:words.index(BREAK)] if BREAK in words else words))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], ["lang", "w"])

    return run


def _boundaries(rows: DataFrame) -> list[Boundary]:
    """Quantiles of the sampled windows; without effect on results."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    step = max(4096, size // SAMPLES)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("w", T.BinaryType())])
    got = rows.mapInArrow(_sampled(step), schema).toArrow()  # 2**18 rows, about
    keys = sorted((lang.encode(), *w.split(b" "), *[b""] * (LENGTH - 1 - w.count(b" "))) for lang, w in zip(got["lang"].to_pylist(), got["w"].to_pylist(), strict=True))
    # a word takes six bytes, about
    n = int(min(MOST_RANGES, max(1, size / 6 / RANGE), max(1, len(keys))))
    return sorted({keys[len(keys) * k // n] for k in range(1, n)})


def _range_of(boundaries: list[Boundary], lang: bytes, words: list[bytes]) -> int:
    key = (lang, *words, *[b""] * (LENGTH - len(words)))
    at = bisect_left(boundaries, key)
    return at + (at < len(boundaries) and boundaries[at] == key)


_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("f", T.LongType())])


def _counted(least: int):
    """Of a range's transducers: (lang, phrase, k, f) of the phrases with at
    least so many windows, of those shared with neighbours, and with k = 0 the
    number of words."""

    def run(group: pa.Table) -> pa.Table:
        out = []
        langs, data = group.column("lang").to_pylist(), group.column("data")
        for lang in sorted(set(langs)):
            words, w, weight = united([Transducer.from_bytes(data[i].as_py()) for i, x in enumerate(langs) if x == lang])
            out.append((lang, "", 0, int(weight.sum())))
            for k in range(1, LENGTH + 1):
                at = _starts(w, k)
                f = np.add.reduceat(weight, at)
                keep = f >= least
                keep[[0, -1]] = True
                keep &= w[at, k - 1] != 0
                for row, n in zip(w[at[keep], :k].tolist(), f[keep].tolist(), strict=True):
                    out.append((lang, b" ".join(words[i - 1] for i in row).decode("utf-8", "surrogatepass"), k, n))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["lang", "phrase", "k", "f"])

    return run


def _with_range(phrases: DataFrame, boundaries: list[Boundary]) -> DataFrame:
    """range beside lang and phrase (and what else phrases has)."""

    def run(batches):
        for batch in batches:
            at = [_range_of(boundaries, lang.encode(), p.encode().split(b" ")) for lang, p in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["range", *batch.schema.names])

    return phrases.mapInArrow(run, T.StructType([T.StructField("range", T.IntegerType()), *phrases.schema.fields]))


def _numbered(phrases: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    words = sorted(set(chain.from_iterable(phrases)))
    index = {x: k + 1 for k, x in enumerate(words)}
    w = np.zeros((len(phrases), LENGTH), np.int32)
    for i, p in enumerate(phrases):
        w[i, :len(p)] = [index[x] for x in p]
    return words, w


def _composed(key, counts: pa.Table, asked: pa.Table) -> pa.Table:
    """The counts of the phrases asked for in one range."""
    langs, phrases = asked.column("lang").to_pylist(), [p.encode().split(b" ") for p in asked.column("phrase").to_pylist()]
    have_lang, have = counts.column("lang").to_pylist(), [p.encode().split(b" ") for p in counts.column("phrase").to_pylist()]
    have_f, f = counts.column("f").to_numpy(), np.zeros(len(phrases), np.int64)
    for lang in set(langs):
        mine, own = [i for i, x in enumerate(langs) if x == lang], [i for i, x in enumerate(have_lang) if x == lang]
        words, w = _numbered([have[i] for i in own])
        transducer = Transducer.of_phrases(words, *_sorted_sums(w, have_f[own], len(words)))
        f[mine] = transducer.compose([phrases[i] for i in mine])
    return pa.table([asked.column("lang"), asked.column("phrase"), pa.array(f)], ["lang", "phrase", "f"])


class PhraseCounts:
    """Exact counts of the phrases of up to four words that occur at least
    ``least`` times in a language.

    counts: lang, phrase, k (words), f; totals: lang, n (all word occurrences)."""

    def __init__(self, docs: DataFrame, least: int = 30):
        if least < 1:
            raise ValueError("least must be at least 1")
        rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
        self.boundaries = _boundaries(rows)
        schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("data", T.BinaryType())])
        shards = rows.mapInArrow(_shards(self.boundaries), schema)
        partial = shards.groupBy("range").applyInArrow(_counted(least), _COUNTS)
        table = settle(partial.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter((F.col("k") == 0) | (F.col("f") >= least)), "phrase-counts")
        self.counts = table.filter("k > 0")
        self.totals = table.filter("k = 0 and f > 0").select("lang", F.col("f").alias("n"))

    def lookup(self, phrases: DataFrame) -> DataFrame:
        """lang, phrase, f of the distinct phrases (at most four words joined
        by one blank) of a table; f is 0 below ``least``."""
        asked = _with_range(phrases.select("lang", "phrase").filter("lang is not null and phrase is not null").distinct(), self.boundaries)
        counts = _with_range(self.counts.select("lang", "phrase", "f"), self.boundaries)
        schema = T.StructType([f for f in _COUNTS.fields if f.name != "k"])
        return counts.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(_composed, schema)


# ------------------------------------------------------------ collocations

def _words(phrase: str, lo, hi):
    return F.array_join(F.slice(phrase, lo, hi), " ")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of 2 to 4 words found
    at least ``least`` times, by their lowest-scoring cut into two parts
    (floor(2000000 * a / (l + r)); ties: the earliest cut), without those
    contained in a longer one found percent of the times; each language's
    first ``top``."""
    found = PhraseCounts(docs, least)
    phrases = found.counts.filter("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = settle(phrases.select("lang", "phrase", F.col("f").alias("a"), "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _words("w", F.lit(1), F.col("cut")).alias("left"), _words("w", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right")), "phrase-cuts")
    parts = cuts.select("lang", F.col("left").alias("phrase")).union(cuts.select("lang", F.col("right")))
    known = settle(found.lookup(parts), "phrase-parts")
    of = lambda part, name: spread(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).withColumn("num", F.lit(2000000) * F.col("a").cast("decimal(30,0)")).withColumn(
        "den", (F.col("l").cast("decimal(30,0)") + F.col("r").cast("decimal(30,0)"))).withColumn("score", F.expr("num div den"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))

    inner = phrases.filter("k > 2").select("lang", "f", "k", "w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m")).select(
        "lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at")).select("lang", _words("w", F.col("at"), F.col("m")).alias("phrase"), "f")
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (F.lit(100) * whole("longest") < F.lit(percent) * whole("a"))).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's first rows are among the first of its slices
    slices = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices))).withColumn(
        "in_slice", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("in_slice") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(found.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
