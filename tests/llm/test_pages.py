"""Titles, components, page splits."""

import numpy as np
import pytest

from lumenfold.llm import pages
from lumenfold.llm.components import components


@pytest.mark.parametrize(
    ("one", "two", "same"),
    [("A_b", "A b", True), ("A%20b", "A b", True), ("A  b ", "A b", True), ("A &amp; b", "A & b", True), ("A %26amp%3B b", "A & b", True), ("é", "é", True), ("a b", "A b", False), ("A (film)", "A", False), ("100% x", "100% x", True), ("A.b", "Ab", False), ("A-b", "A b", False)],
)
def test_titles(one, two, same):
    assert (pages.title_key(one) == pages.title_key(two)) == same


def test_blank_titles_name_nothing():
    assert pages.title_key(None) is pages.title_key("  _") is None


def test_components_against_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 7), (2000, 2001), (2000, 2001)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


ROWS = [(1, "A b", "train"), (1, None, "TRAIN "), (2, "A_b", "val"), (3, "C", "train"), (3, "D", None), (4, "D", "test"), (5, "E", "val"), (6, "e", "test"), (7, None, "train"), (8, None, "val"), (None, "E", "train"), (9, "", "train"), (10, " ", "val"), (2, "A b", "val")]


def test_spread_articles(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "wiki_id long, title string, split string, page string")
    assert {r.wiki_id for r in pages.spread_articles(df).collect()} == {1, 2, 3, 4}
    assert pages.spread_articles(df.limit(0)).count() == 0


def test_one_title_with_most_rows(spark):
    df = spark.createDataFrame([(i, "Hot page", "train" if i % 2 else "val") for i in range(500)] + [(1000 + i, f"t{i}", "train") for i in range(200)], "wiki_id long, title string, split string")
    assert pages.spread_articles(df).count() == 500


def test_splits_keep_pages_and_shares(spark):
    rng = np.random.default_rng(3)
    rows = [(int(w), f"T{w // 3}" if w % 5 == 0 else f"U{w}") for w in range(300) for _ in range(int(rng.integers(1, 5)))]
    df = spark.createDataFrame(rows, "wiki_id long, title string")
    got = pages.assign_splits(df).collect()
    assert len(got) == 300 and all(len({r.new_split for r in got if r.page == p}) == 1 for p in {r.page for r in got})
    by = {r.article: r.new_split for r in got}
    shares = {s: sum(by[w] == s for w, _ in rows) / len(rows) for s in ("train", "val", "test")}
    assert abs(shares["val"] - 0.15) < 0.005 and abs(shares["test"] - 0.15) < 0.005
    assert pages.assign_splits(df.limit(0)).count() == 0


def test_subset_sums_come_closest():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = {int(s): int(c) for s, c in zip(rng.integers(1, 30, 4), rng.integers(1, 4, 4))}
        target = int(rng.integers(0, 80))
        sums = {0}
        for s, c in sizes.items():
            sums = {t + s * k for t in sums for k in range(c + 1)}
        taken = pages.choose(sizes, target)
        assert all(0 <= taken[s] <= sizes[s] for s in taken)
        assert abs(sum(s * c for s, c in taken.items()) - target) == min(abs(t - target) for t in sums)


@pytest.mark.parametrize("rows", [10**5, 10**7, 10**8, 10**9, 10**11])
def test_shares_at_any_size(rows):
    """A hub with a tenth of the rows, pages of 1 to 4."""
    counted = {rows // 10: 1} | {s: 9 * rows // 100 for s in range(1, 5)}
    total, got = sum(s * n for s, n in counted.items()), {}
    for size, low, high, name in pages.split_plan(counted, pages.SHARES):
        assert 0 <= low < high <= counted[size]
        got[name] = got.get(name, 0) + size * (high - low)
    assert all(abs(got[name] / total - share) < 0.001 for name, share in pages.SHARES.items())


def test_many_rows_as_few():
    """Units and the exact end come as close as small pages allow, never take more than there are, and lose no size."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        sizes = {int(s): int(c) for s, c in zip(rng.integers(1, 400, 8), rng.integers(1, 30, 8))} | {1: 40}
        target = int(rng.integers(1, sum(s * n for s, n in sizes.items()) // 2))
        taken = pages.choose_from_many(sizes, target, 64)
        assert all(0 <= n <= sizes[s] for s, n in taken.items())
        assert abs(sum(s * n for s, n in taken.items()) - target) <= max(40, target // 10)
    assert sum(s * n for s, n in pages.choose_from_many({1: 1000}, 500, 64).items()) == 500


def test_splits_over_many_rows(spark, monkeypatch):
    rows = [(w, f"U{w}") for w in range(3000) for _ in range(1 + w % 4)] + [(5000, "hub")] * 800
    df = spark.createDataFrame(rows, "wiki_id long, title string")
    monkeypatch.setattr(pages, "split_plan", lambda counted, shares, plan=pages.split_plan: plan(counted, shares, 300))
    by = {r.article: r.new_split for r in pages.assign_splits(df).collect()}
    shares = {s: sum(by[w] == s for w, _ in rows) / len(rows) for s in ("train", "val", "test")}
    assert abs(shares["val"] - 0.15) < 0.001 and abs(shares["test"] - 0.15) < 0.001
