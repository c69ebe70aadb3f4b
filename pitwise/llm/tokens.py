"""Words of many texts at once, as numpy arrays of 64-bit hashes.

Texts are taken in chunks of about ``CHUNK`` bytes, so the arrays of a task
stay small however many rows an Arrow batch has; one longer text is a chunk
of its own, whose bytes are hashed in segments of ``SEGMENT``.  A word hash is
a polynomial over random byte values, finished by a mixing step; the hash of a
run of words comes from prefix sums in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
SEGMENT = 1 << 20
NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)

_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd, 3 modulo 4
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**n modulo 2**64 (or of its inverse), kept and grown."""
    have = _powers.get((base, inverse))
    if have is None or len(have) <= n:
        b = pow(base, -1, 1 << 64) if inverse else base
        size = max(1 << n.bit_length(), 1 << 16) + 1
        have = np.ones(size, np.uint64)
        have[1:] = b
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base, inverse] = have
    return have[: n + 1]


def _classes(kind: str) -> np.ndarray:
    t = np.ones(256, bool)
    if kind == "space":        # [^\x20\x09-\x0D]+
        t[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "alnum":      # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text with A-Z lower-cased
        t[:0x80] = False
        t[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    else:
        raise ValueError(f"unknown kind of word: {kind}")
    return t


_IS_WORD = {k: _classes(k) for k in ("space", "alnum")}


def _values(lower: bool, salt: int) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x51ED27))
    if lower:
        v[0x41:0x5B] = v[0x61:0x7B]
    return v


_VALUES = {(lower, salt): _values(lower, salt) for lower in (False, True) for salt in (0, 1)}


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts, of about CHUNK characters each."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += n + 1
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """The words of some texts.

    ``first[d]:first[d+1]`` are the words of text ``d``; ``hash(salt)`` their
    hashes; ``doc`` the text of each word; ``stop`` the end of its text.
    """

    def __init__(self, texts: list[str | None], kind: str = "space", lower: bool = False):
        data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        size = np.fromiter((len(b) + 1 for b in data), np.int64, len(data))
        self.at = np.concatenate(([0], np.cumsum(size)))
        self.buf = np.frombuffer(b" ".join([*data, b""]), np.uint8)
        self.lower = lower
        edge = np.zeros(len(self.buf) + 2, np.int8)
        edge[1:-1] = _IS_WORD[kind][self.buf]
        step = np.diff(edge)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.stop = np.repeat(self.first[1:], self.count)
        self._sums: dict[int, np.ndarray] = {}

    def hash(self, salt: int = 0) -> np.ndarray:
        value, out, i, n = _VALUES[self.lower, salt], np.empty(len(self.start), np.uint64), 0, len(self.start)
        while i < n:
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, lo + SEGMENT, "right")))
            size = int(self.end[j - 1] - lo)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(value[self.buf[lo:lo + size]] * powers(_BASES[0], size)[:size], out=sums[1:])
            a, b = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = (sums[b] - sums[a]) * powers(_BASES[0], size, True)[a]
            i = j
        return mix(out)

    def runs(self, lo: np.ndarray, hi: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of the word runs lo:hi (word indices of the whole chunk), never 0 or NO_HASH."""
        n = len(self.start)
        sums = self._sums.get(salt)
        if sums is None:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hash(salt) * powers(_BASES[1], n)[:n], out=sums[1:])
            self._sums[salt] = sums
        h = mix((sums[hi] - sums[lo]) * powers(_BASES[1], n, True)[lo] + (hi - lo).astype(np.uint64))
        return np.clip(h, np.uint64(1), NO_HASH - np.uint64(1))


def slide(a: np.ndarray, w: int, op, fill: int) -> np.ndarray:
    """op over a[i:i+w] for each i; beyond the end stands fill."""
    out, width = a, 1
    while width < w:
        step = min(width, w - width)
        shifted = np.full_like(out, fill)
        if step < len(out):
            shifted[: len(out) - step] = out[step:]
        out, width = op(out, shifted), width + step
    return out


def winnow(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed k-grams: in each run of w
    consecutive k-grams of a text, those of the least hash (all, if tied).
    Equal runs of w+k-1 words hence share a selected k-gram at the same place."""
    n = len(words.start)
    if n < k + w - 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    i = np.arange(n)
    gram = np.full(n, NO_HASH, np.uint64)
    whole = i + k <= words.stop
    gram[whole] = words.runs(i[whole], i[whole] + k)
    least = slide(gram, w, np.minimum, int(NO_HASH))
    least[i + (w + k - 1) > words.stop] = 0
    most = slide(least[::-1], w, np.maximum, 0)[::-1]
    chosen = np.flatnonzero(whole & (most == gram))
    return chosen, gram[chosen]
