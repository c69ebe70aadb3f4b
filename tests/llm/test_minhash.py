"""op11: min-max hashing against all pairs, and its edge cases."""

import random

import numpy as np
import pytest

from pitwise.llm import minhash
from tests.llm import brute
from tests.llm.conftest import CLASHING
from tests.llm.test_operators import planted, prose, rows_of

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def expected(rows, n, percent):
    return sorted([(i, s, c, i == c) for i, s, c in brute.near_duplicates(rows, n, percent)], key=repr)


@pytest.mark.parametrize(("n", "percent"), [(4, 80), (2, 55), (5, 100)])
def test_links_are_those_of_all_pairs(spark, docs, n, percent):
    rows = planted(seed=percent)
    got = minhash.near_duplicates(docs(rows, CLASHING), n, percent)
    assert rows_of(got, *COLUMNS) == expected(rows, n, percent)


def test_chains_and_small_sets(spark, docs):
    """A chain of which only neighbours link, and sets of one to ten shingles."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = [(500 - k, " ".join(words[8 * k:8 * k + 120])) for k in range(30)]
    base = [prose(rng, k) for k in range(1, 14)]
    rows += [(1000 + k, t) for k, t in enumerate(base)] + [(2000 + k, f"{t} tail") for k, t in enumerate(base)]
    got = minhash.near_duplicates(docs(rows), 4, 80)
    want = expected(rows, 4, 80)
    assert rows_of(got, *COLUMNS) == want
    assert len({c for i, _, c, _ in want if i <= 500}) == 1


def test_a_large_group_of_near_copies(spark, docs):
    """Every pair of 150 near copies shares buckets; groups a bit apart from
    each other do not link."""
    rng = random.Random(8)
    common = prose(rng, 160).split(" ")
    rows = []
    for k in range(150):
        w = list(common)
        for _ in range(rng.choice((1, 3, 5, 9))):
            w[rng.randrange(160)] = f"x{rng.randrange(10000)}"
        rows.append((k, " ".join(w)))
    got = minhash.near_duplicates(docs(rows), 4, 80)
    assert rows_of(got, *COLUMNS) == expected(rows, 4, 80)


def test_pairs_that_cannot_link_leave_the_join(spark, docs, monkeypatch):
    """Members alike that do not link, whose changes others have too: next to
    none of their pairs leaves the join across components."""
    rng = random.Random(12)
    common = prose(rng, 160).split(" ")
    changes = [(k, f"x{k}") for k in range(4, 156, 3)]
    rows = []
    for k in range(120):
        w = list(common)
        for at, word in rng.sample(changes, 4):
            w[at] = word
        rows.append((k, " ".join(w)))
    settled, seen = minhash.settle, {}

    def spy(df, name):
        seen[name] = settled(df, name)
        return seen[name]

    monkeypatch.setattr(minhash, "settle", spy)
    got = minhash.near_duplicates(docs(rows), 4, 80)
    assert rows_of(got, *COLUMNS) == expected(rows, 4, 80)
    apart = seen["minhash-rest"].select("id").distinct().count()
    assert apart > 60 and seen["minhash-rest-pairs"].count() <= 2 * apart


def test_the_map_of_shingles_bounds_what_two_sets_share():
    rng = np.random.default_rng(3)
    for size in (1, 50, 150, 900, 5000):
        u = np.unique(rng.integers(0, 1 << 63, 2 * size).astype(np.uint64))
        x, y = u[:size + size // 2], u[size // 2:]
        a, b = minhash.marks(x), minhash.marks(y)
        lacks = lambda p, q: int(np.bitwise_count((p & ~q).view(np.uint64)).sum())
        assert len(np.intersect1d(x, y)) <= min(len(x) - lacks(a, b), len(y) - lacks(b, a))


def test_repeated_and_missing_ids(spark, docs):
    """Rows of one id are one document, which links by any of its texts."""
    rng = random.Random(9)
    a, b = prose(rng, 100), prose(rng, 100)
    rows = [(7, a), (7, b), (3, a + " x"), (9, b + " y"), (9, b + " y"), (None, a), (None, None), (8, None), (8, a), (4, "")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(docs(rows), 4, 80).collect())
    size = {t: len(brute.shingles(t, 4)) for t in (a, b, a + " x", b + " y")}
    want = [("3", size[a + " x"], "3", True), ("4", 0, "4", True), ("7", size[a], "3", False), ("7", size[b], "3", False), ("8", 0, "3", False), ("8", size[a], "3", False),
            ("9", size[b + " y"], "3", False), ("9", size[b + " y"], "3", False), ("None", 0, "None", True), ("None", size[a], "None", True)]
    assert got == sorted(want)


def test_empty_table_and_bad_parameters(spark, docs):
    assert minhash.near_duplicates(docs([])).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs([]), percent=0)


def test_signature_agreement_estimates_jaccard():
    """Minima and maxima together: unbiased, and of lower variance than as many minima."""
    rng = np.random.default_rng(1)
    errors = {"both": [], "minima": []}
    for _ in range(200):
        u = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        x, y = np.unique(u[:250]), np.unique(u[50:])
        low, high = minhash.signatures([x, y], 128)
        errors["minima"].append((low[0] == low[1]).mean() - 200 / 300)
        errors["both"].append(((low[0, :64] == low[1, :64]).mean() + (high[0, :64] == high[1, :64]).mean()) / 2 - 200 / 300)
    assert abs(np.mean(errors["both"])) < 0.01
    assert np.var(errors["both"]) < 1.1 * np.var(errors["minima"])


def test_banding_bounds_the_miss():
    for percent in (50, 80, 90, 97):
        plan, j = minhash.banding(percent), percent / 100
        assert plan.bands % 2 == 0 and (1 - j**plan.rows) ** plan.bands <= 1e-11
        # the bit limit lets all but 1e-12 of the pairs that just link pass
        rng = np.random.default_rng(percent)
        assert (rng.binomial(plan.bits, (1 - j) / 2, 100000) <= plan.limit).all()


def test_texts_longer_than_a_block(spark, docs):
    rng = random.Random(4)
    long = prose(rng, 60000)
    rows = [(1, long), (2, long + " more"), (3, prose(rng, 50))]
    assert rows_of(minhash.near_duplicates(docs(rows), 4, 80), *COLUMNS) == expected(rows, 4, 80)
