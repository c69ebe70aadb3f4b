"""op12: count transducers and collocations against plain counting."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitwise.llm import phrases
from tests.llm import brute
from tests.llm.conftest import CLASHING, DOCS
from tests.llm.test_operators import prose, rows_of

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.fixture()
def texts(spark):
    def make(rows, extra=()):
        return spark.createDataFrame([(k, t, lang, None, None, *("x" for _ in extra)) for k, (lang, t) in enumerate(rows)],
                                     "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra))

    return make


def sample(seed, n=60, langs=("en", "de", None, "")):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "city", "the", "of", "é", "x\x01y", "ab", "漢字"]
    out = []
    for _ in range(n):
        pieces = [prose(rng, rng.choice((0, 1, 2, 3, 4, 9, 40)), vocabulary) for _ in range(rng.randint(0, 8))]
        out.append((rng.choice(langs), "".join(p + rng.choice((". ", ",", "\n", " \t", "!\x0b")) for p in pieces)))
    return [*out, ("en", None), ("en", ""), (None, " \t"), ("en", "...")]


windows = st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=1, max_size=4), st.integers(1, 9)), max_size=40)


@given(windows, st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), max_size=20))
@settings(max_examples=80, deadline=None)
def test_transducer_holds_and_gives_back_its_windows(rows, asked):
    words = [b"a", b"b", b"c\x01", b"d", b"\xc3\xa9"]
    total = Counter()
    for w, n in rows:
        total[tuple(w)] += n
    w = np.array([[*r, *[0] * (4 - len(r))] for r, _ in rows], np.int32).reshape(-1, 4)
    t = phrases.Transducer.of_windows(words, *phrases._sorted_sums(w, np.array([n for _, n in rows], np.int64), 5))
    t = phrases.Transducer.from_bytes(t.to_bytes())
    got_w, got_n = t.windows()
    assert {tuple(x for x in r if x): n for r, n in zip(got_w.tolist(), got_n.tolist(), strict=True)} == dict(total)
    names = [*words, b"other"]
    want = [sum(n for r, n in total.items() if r[:len(q)] == tuple(q)) for q in asked]
    assert t.compose([[names[x - 1] for x in q] for q in asked]).tolist() == want
    both = phrases.united([t, t])
    assert dict(zip(map(tuple, both[1].tolist()), both[2].tolist(), strict=True)) == {(*k, *[0] * (4 - len(k))): 2 * n for k, n in total.items()} or not total


def test_equal_continuations_are_one_state():
    w = np.array([[k, 11, 12, 13] for k in range(1, 11)], np.int32)
    t = phrases.Transducer.of_windows([b"%02d" % k for k in range(13)], w, np.ones(10, np.int64))
    assert len(t.first) - 1 == 5 and len(t.label) == 13


def test_many_words_sort_alike():
    """More words than fit one 64-bit key."""
    rng = np.random.default_rng(2)
    w = rng.integers(1, 70000, (500, 4)).astype(np.int32)
    w = np.concatenate([w, w[:100]])
    few, many = (phrases._sorted_sums(w, np.ones(600, np.int64), n) for n in (65535, 1 << 20))
    assert len(many[0]) == 500 and many[1].sum() == 600 and (np.sort(few[1]) == np.sort(many[1])).all()
    assert many[0].tolist() == sorted(many[0].tolist())


@pytest.mark.parametrize("size", [7, 64, 1 << 18])
def test_segments_do_not_cut_words(monkeypatch, size):
    monkeypatch.setattr(phrases, "SEGMENT", size)
    for _, t in sample(3):
        words = [x for s in phrases.segments(t or "") for x in s]
        want = [x for p in brute.PIECE.split((t or "").translate(brute.LOWER)) for x in [*brute.BLANK_WORD.findall(p), "\xff"]][:-1]
        assert [x.decode() if x != phrases.BREAK else "\xff" for x in words] == want


@pytest.mark.parametrize(("shard", "range_"), [(1 << 20, 1 << 20), (150, 60)])
def test_collocations_are_those_of_plain_counting(spark, texts, monkeypatch, shard, range_):
    """Also with many shards and prefix ranges that cut phrases' counts."""
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "RANGE", range_)
    rows = sample(1, 150) + [("en", "the end of the world. " * 40)] * 2
    df = texts(rows, [c for c in CLASHING if c != "n_words"])
    if range_ < 1000:
        monkeypatch.setattr(phrases, "_boundaries", lambda _: sorted({(lang, *w) for lang in (b"", b"de", b"en", b"und") for w in (
            (b"city", b"", b"", b""), (b"city", b"new", b"zzz", b""), (b"the", b"of", b"the", b""), (b"the", b"of", b"the", b"of"), (b"\xc3\xa9", b"", b"", b""))}))
    for least, percent, top in ((30, 80, 2000), (5, 60, 7)):
        got = phrases.collocations(df, least, percent, top)
        assert rows_of(got, *COLUMNS) == sorted(brute.collocations(rows, least, percent, top), key=repr)


def test_lookup_gives_exact_counts_and_zero(spark, texts):
    rows = sample(2, 80)
    found = phrases.PhraseCounts(texts(rows), 3)
    asked = spark.createDataFrame([("en", "the of"), ("en", "new york city the"), ("en", "nothing here"), ("zz", "the"), ("und", "漢字"), ("en", "the of"), (None, "x")], "lang string, phrase string")
    counts = Counter()
    for lang, t in rows:
        for piece in brute.PIECE.split((t or "").translate(brute.LOWER)):
            w = brute.BLANK_WORD.findall(piece)
            counts.update(("und" if lang is None else lang, " ".join(w[s:s + k])) for k in range(1, 5) for s in range(len(w) - k + 1))
    got = {(r.lang, r.phrase): r.f for r in found.lookup(asked).collect()}
    assert len(got) == 5 and all(n == (counts[key] if counts[key] >= 3 else 0) for key, n in got.items())


def test_large_counts_are_exact(spark):
    """Products past 64 bits."""
    big = spark.sql("SELECT 2000000 * cast(9000000000000000000 AS decimal(30,0)) div (cast(9000000000000000000 AS decimal(30,0)) + cast(9200000000000000000 AS decimal(30,0))) AS score")
    assert big.first().score == 2000000 * 9000000000000000000 // (9000000000000000000 + 9200000000000000000)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(spark.createDataFrame([], DOCS), least=0)
