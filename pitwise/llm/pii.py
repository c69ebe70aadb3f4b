"""PII by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes
and identifier cues.  A deterministic parser expands each anchor to its
boundaries and validates it.

Base kinds (leftmost, non-overlapping within a kind; a match that fails its
check is dropped, without another try):

- email   ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
- ip      four dotted numbers, each at most 255
- card    digits with single blanks or hyphens between, 13 to 19, passing Luhn
- phone   ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 9 to 15 digits

Added kinds:

- uri      a ``mailto:`` or ``tel:`` address, or a ``scheme://`` address that
           carries a login before an at-sign
- account  the identifier after a cue (account, iban, passport, ssn, token,
           password, secret, api key): 6 or more of ``[A-Za-z0-9_-]`` with a
           digit, after blanks, quotes, colons or equals signs

Offsets are code points, end exclusive.  Null and empty texts have no spans;
whole texts are scanned, each row alone, in time linear in the text; repeated
rows are scanned one by one.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "uri", "account")

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_DIAL = _DIGITS | frozenset(" ().-")
_VALUE = _ALNUM | frozenset("_-")
_GAP = frozenset(" \t\"':=#.")
_STOP = frozenset(" \t\n\r\x0b\x0c\"'<>()[]{}|\\^`")
_CUES = ("account", "iban", "passport", "ssn", "token", "password", "secret", "api_key", "api-key", "apikey", "api key")
_SCHEMES = ("mailto:", "tel:")

_found: list[ahocorasick.Automaton] = []


def _anchors() -> ahocorasick.Automaton:
    if not _found:
        a = ahocorasick.Automaton()
        for x in "@+":
            a.add_word(x, (x, 1))
        for x in _DIGITS:
            a.add_word(x, ("0", 1))
        a.add_word("://", ("://", 3))
        for kind, words in (("cue", _CUES), ("scheme", _SCHEMES)):
            for x in words:
                for form in {x, x.upper(), x.capitalize(), x.title()}:
                    a.add_word(form, (kind, len(x)))
        a.make_automaton()
        _found.append(a)
    return _found[0]


def _run(text: str, i: int, allowed: frozenset) -> int:
    """The end of the run of allowed characters from i."""
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    s = at
    while s > floor and text[s - 1] in _LOCAL:
        s -= 1
    e = _run(text, at + 1, _LABEL)
    if s == at or e == at + 1:
        return None
    labels = 0
    while e < len(text) and text[e] == "." and (next_ := _run(text, e + 1, _LABEL)) > e + 1:
        e, labels = next_, labels + 1
    return (s, e) if labels else None


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGITS:
        return None
    e = _run(text, plus + 2, _DIAL)
    while e > plus + 3 and text[e - 1] not in _DIGITS:
        e -= 1
    return (plus, e) if e > plus + 3 and text[e - 1] in _DIGITS else None


def _luhn(digits: list[int]) -> bool:
    odd = digits[-1::-2]
    even = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def _numbers(text: str, runs: list[tuple[int, int]]) -> tuple[list, list]:
    """ip and card spans from the runs of digits."""
    ips, cards, i = [], [], 0
    while i + 3 < len(runs):
        four = runs[i:i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            # leading zeros aside, a part of over three digits is over 255
            if all(len(p := text[s:e].lstrip("0")) <= 3 and int(p or "0") <= 255 for s, e in four):
                ips.append((four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j, n = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        if 13 <= n <= 19:
            s, e = runs[i][0], runs[j][1]
            if _luhn([int(c) for c in text[s:e] if c in _DIGITS]):
                cards.append((s, e))
        i = j + 1
    return ips, cards


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind as listed in KINDS, then start."""
    if not text:
        return []
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    runs: list[tuple[int, int]] = []
    last, run_start, run_end = dict.fromkeys(KINDS, 0), -1, -1
    for end, (kind, size) in _anchors().iter(text):
        start = end + 1 - size
        if kind == "0":
            if start == run_end:
                run_end = end + 1
            else:
                if run_end >= 0:
                    runs.append((run_start, run_end))
                run_start, run_end = start, end + 1
        elif kind == "@":
            if start >= last["email"] and (x := _email(text, start, last["email"])):
                spans["email"].append(x)
                last["email"] = x[1]
        elif kind == "+":
            if start >= last["phone"] and (x := _phone(text, start)):
                last["phone"] = x[1]
                if 9 <= sum(c in _DIGITS for c in text[x[0]:x[1]]) <= 15:
                    spans["phone"].append(x)
        elif kind in ("://", "scheme"):
            if start < last["uri"]:
                continue
            s, e = start, end + 1
            while kind == "://" and s > last["uri"] and text[s - 1] in _LABEL:
                s -= 1
            while e < len(text) and text[e] not in _STOP:
                e += 1
            host = text[end + 1:e].split("/", 1)[0]
            last["uri"] = e
            if s < start and "@" in host[1:] if kind == "://" else e > end + 1:
                spans["uri"].append((s, e))
        elif start >= last["account"] and not (start and text[start - 1] in _ALNUM):
            s = end + 1
            while s < len(text) and s < end + 9 and text[s] in _GAP:
                s += 1
            e = _run(text, s, _VALUE)
            if s > end + 1 and e - s >= 6 and any(c in _DIGITS for c in text[s:e]):
                spans["account"].append((s, e))
                last["account"] = e
    if run_end >= 0:
        runs.append((run_start, run_end))
    spans["ip"], spans["card"] = _numbers(text, runs)
    return [(k, s, e) for k in KINDS for s, e in spans[k]]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, or union of overlapping spans, replaced by the
    name of the first's kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    order = sorted(spans, key=lambda x: (x[1], -x[2]))
    i = 0
    while i < len(order):
        kind, s, e = order[i]
        while i + 1 < len(order) and order[i + 1][1] < e:
            i += 1
            e = max(e, order[i][2])
        out += [text[at:s], f"[{kind.upper()}]"]
        at, i = e, i + 1
    return "".join([*out, text[at:]])


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the counts of the base kinds, base_sha256, spans, redacted (the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column("text").to_pylist()
                found = [find_spans(t) for t in texts]
                counts = [pa.array([sum(x[0] == k for x in f) for f in found], pa.int64()) for k in BASE]
                base = [hashlib.sha256(_listed([x for x in f if x[0] in BASE]).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([_listed(f) for f in found], pa.string()),
                     pa.array([redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string())],
                    ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "redacted"])

    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE),
        *(T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", "redacted"))])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every span of their texts replaced; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = pa.array([redact(t, find_spans(t)) for t in batch.column(i).to_pylist()], batch.schema.field(i).type)
            yield batch.set_column(i, batch.schema.field(i), texts)

    return docs.mapInArrow(run, docs.schema)
