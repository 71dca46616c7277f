"""Near-duplicates, cross-split overlaps, leaks: against brute force and at their edges."""

from collections import Counter

import numpy as np
import pytest

from lumenfold.llm import blocks, leakage, neardup, overlap, rarity
from lumenfold.llm.words import Bags, words


def bag(text):
    return Counter(words(text))


def agreement(a, b):
    x, y = bag(a), bag(b)
    longer = max(sum(x.values()), sum(y.values()))
    return sum((x & y).values()) / longer if longer else 0.0


VOCABULARY = [f"w{i}" for i in range(400)]


def random_texts(n, seed=0):
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        if i and rng.random() < 0.4:  # an edited copy
            own = texts[rng.integers(len(texts))].split()
            for _ in range(rng.integers(0, 6)):
                at = rng.integers(len(own))
                own[at] = VOCABULARY[rng.integers(400)]
            rng.shuffle(own)
        else:
            own = ["the", "of", "a"] * 3 + [VOCABULARY[j] for j in rng.integers(0, 400, rng.integers(10, 40))]
        texts.append(" ".join(own))
    return texts


def pairs_of(df):
    return {(r.passage_a, r.passage_b) for r in df.collect()}


def test_words_follow_the_definition():
    assert words("Ｆｕｌｌ-width STRASSE_x Straße 3½ don't") == ["full", "width", "strasse", "x", "strasse", "31", "2", "don", "t"]
    assert words(None) == words("") == words(" \t…") == []


def test_bags_count_repetitions():
    bags = Bags(["a a b", "b a a", "a b", None, ""])
    assert bags.signature[0] == bags.signature[1] != bags.signature[2]
    assert bags.count.tolist() == [3, 3, 2, 0, 0] and not bags.full[3:].any()
    assert len(set(bags.elements[:3].tolist())) == 3


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    base = [VOCABULARY[j] for j in rng.permutation(400)[:60]]
    other = base[:54] + ["x1", "x2", "x3", "x4", "x5", "x6"]
    bags = Bags([" ".join(base), " ".join(other)])
    sampled = neardup.samples(bags, np.array([0, 1]), 512, np.ones(len(bags.elements)))
    low, high = neardup.odd_sketch(sampled[:64])
    ones = int(np.bitwise_count(low[0] ^ low[1]) + np.bitwise_count(high[0] ^ high[1]))
    assert abs(neardup.similarity(ones) - 54 / 66) < 0.2
    assert abs((sampled[:, 0] == sampled[:, 1]).mean() - 54 / 66) < 0.08
    assert neardup.similarity(0) == 1.0 and neardup.similarity(64) == 0.0


def test_near_duplicates_against_brute_force(spark):
    texts = random_texts(300)
    rows = [(f"{i}", t) for i, t in enumerate(texts)]
    want = {tuple(sorted((a, b))) for a, x in rows for b, y in rows if a < b and agreement(x, y) >= 0.75}
    found = pairs_of(neardup.near_duplicate_pairs(spark.createDataFrame(rows, "passage_id string, text string")))
    assert found <= want
    assert len(found) >= 0.97 * len(want) > 50


def test_edits_of_the_rarest_words_are_found(spark):
    rng = np.random.default_rng(4)
    common = [[VOCABULARY[j] for j in rng.permutation(90)[:15]] for _ in range(300)]
    rows = [(f"{side}{i:03d}", " ".join(own + [f"{side}{i}x{j}" for j in range(5)])) for i, own in enumerate(common) for side in "ab"]
    want = {tuple(sorted((a, b))) for a, x in rows for b, y in rows if a < b and agreement(x, y) >= 0.75}
    assert len(want) >= 300
    assert pairs_of(neardup.near_duplicate_pairs(spark.createDataFrame(rows, "passage_id string, text string"))) == want


def test_near_duplicates_at_the_edges(spark):
    long_text = " ".join(f"long{i}" for i in range(70_000))
    rows = [("a", "one two three four", 1), ("b", "four three two ONE", 2), ("b", "four three two one", 3), ("c", None, 4), ("d", "", 5), ("e", "!!", 6), (None, "one two three four", 7), ("f", long_text, 8), ("g", long_text + " more", 9), ("h", "one two three five", 10), ("i", "one", 11)]
    df = spark.createDataFrame(rows, "passage_id string, text string, sig int").withColumnRenamed("sig", "elements")
    found = pairs_of(neardup.near_duplicate_pairs(df))
    assert {("a", "b"), ("f", "g")} <= found <= {("a", "b"), ("f", "g"), ("a", "h"), ("b", "h")}
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("local", [5, 1000])
def test_hot_bands_are_cut_into_tiles(spark, monkeypatch, local):
    monkeypatch.setattr(blocks, "HOT", 8)
    monkeypatch.setattr(blocks, "LOCAL", local)
    rows = [(f"{i:03d}", "same words in all of these texts here " + f"x{i}") for i in range(60)]
    found = pairs_of(neardup.near_duplicate_pairs(spark.createDataFrame(rows, "passage_id string, text string")))
    assert len(found) >= 0.9 * 60 * 59 / 2


@pytest.mark.parametrize("copies", [7, 1000])
def test_copies_of_one_text_are_all_paired(spark, monkeypatch, copies):
    monkeypatch.setattr(neardup, "COPIES", copies)
    near = [(f"z{i}", "exactly the same five words more" if i < 9 else "exactly the same five words less") for i in range(20)]
    mixed = [(f"{i:03d}", "exactly the same five words") for i in range(15)] + near
    assert len(pairs_of(neardup.near_duplicate_pairs(spark.createDataFrame(mixed, "passage_id string, text string")))) == 35 * 34 // 2
    rows = [(f"{i:03d}", "exactly the same five words") for i in range(40)]
    assert len(pairs_of(neardup.near_duplicate_pairs(spark.createDataFrame(rows, "passage_id string, text string")))) == 40 * 39 // 2


def test_classes_follow_links(spark):
    base = [f"u{i}" for i in range(20)]
    chain = [" ".join(base[:20]), " ".join(base[:18] + ["x1", "x2"]), " ".join(base[:16] + ["x1", "x2", "x3", "x4"])]
    rows = [("a", chain[0]), ("b", chain[1]), ("c", chain[2]), ("a2", chain[0]), ("d", "alone in here"), ("e", None)]
    got = {r.passage_id: (r["class"], r.links) for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, "passage_id string, text string")).collect()}
    assert set(got) == {"a", "b", "c", "a2", "d"} and got["a"] == got["a2"]
    assert len({got[x][0] for x in "abc"}) == 1 != got["d"][0] and got["d"][1] == 0 and got["b"][1] == 2


def test_shared_terms():
    for n in range(1, 200):
        assert 0.75 * n <= rarity.shared_terms(n, 0.75) < 0.75 * n + 1


def test_bounds_lose_no_pair():
    """Every agreeing pair has a posting of one term in both texts that all bounds let through, and the dot product it needs."""
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(40)], rng.integers(3, 30), p=np.arange(40, 0, -1) / 820)) for _ in range(150)]
    texts += [" ".join(x for x in t.split() if rng.random() > 0.1) for t in texts]
    bags = Bags(texts)
    values, counts = np.unique(bags.elements, return_counts=True)
    order, weight = rarity.heaviest_first(bags, (values, counts, len(texts)))
    sums = np.concatenate(([0], np.cumsum(weight)))
    need = rarity.needs(bags, sums, 0.75)
    accept = overlap.acceptance(0.75)
    listed = []
    for i in range(len(texts)):
        own = np.zeros(bags.count[i], overlap.POSTING)
        at = order[bags.start[i] : bags.start[i] + bags.count[i]]
        own["rest"] = sums[bags.start[i] + bags.count[i]] - sums[bags.start[i] : bags.start[i] + bags.count[i]]
        own["need"], own["n"] = need[i], bags.count[i]
        for e in bags.elements[at]:
            own["low" if e >> np.uint64(57) < 64 else "high"] ^= np.uint64(1) << ((e >> np.uint64(57)) & np.uint64(63))
        listed.append((bags.elements[at], own, weight[bags.start[i] : bags.start[i] + bags.count[i]]))
    columns = [blocks.columns_of(own) for _, own, _ in listed]
    agreed = 0
    for a in range(len(texts)):
        for b in range(a):
            (one, p, w), (two, q, _) = listed[a], listed[b]
            common = np.intersect1d(one, two)
            if len(common) >= 0.75 * max(len(one), len(two)) - 1e-9 and len(one):
                agreed += 1
                met = [(np.flatnonzero(one == e)[0], np.flatnonzero(two == e)[0]) for e in common]
                assert any(p["rest"][i] >= need[a] and q["rest"][j] >= need[b] and accept(columns[a], np.array([i]), columns[b], np.array([j]))[0] for i, j in met)
                assert w[np.isin(one, common)].sum() >= max(need[a], need[b])
    assert agreed > 100


def test_overlaps_against_brute_force(spark):
    texts = random_texts(240, 3)
    rows = [(i % 3 == 0 and 1 or 0, f"{i}", t) for i, t in enumerate(texts)] + [(0, "n", None), (1, "m", ""), (0, "copy", texts[0])]
    df = spark.createDataFrame(rows, "train int, id string, text string")
    found = overlap.overlapping(df).select("a").distinct()
    named = {r.id for r in neardup.bag_members(df.where("train = 0"), "id", "text").join(found.withColumnRenamed("a", "sig"), "sig", "left_semi").collect()}
    train = [t for s, _, t in rows if s == 1]
    assert named == {i for s, i, t in rows if s == 0 and any(agreement(t, u) >= 0.75 for u in train)}
    assert "copy" in named
    assert overlap.overlapping(df.limit(0)).count() == 0


@pytest.mark.parametrize("local", [5, 1000])
def test_overlap_hot_lists_are_cut_into_tiles(spark, monkeypatch, local):
    monkeypatch.setattr(blocks, "HOT", 8)
    monkeypatch.setattr(blocks, "LOCAL", local)
    rows = [(i % 2, "same words in all of these texts here " + f"x{i}") for i in range(60)]
    assert overlap.overlapping(spark.createDataFrame(rows, "train int, text string")).count() == 900


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, "only a few words", "x"), (3, None, "x"), (None, ITEM, "x")], "item_id long, text string, longest string")


def test_leaks_whole_partly_and_reordered(spark, items):
    w = ITEM.split()
    docs = [(1, "before " + ITEM.upper() + " after"), (2, " ".join(w[:13])), (3, " ".join(w[:12])), (4, " ".join(w[:12] + ["x"] + w[12:])), (5, None), (6, ""), (None, ITEM), (1, " ".join(w[:14])), (8, ", ".join(w))]
    got = {r.doc_id: r for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {1, 2, 8} and {r.item_id for r in got.values()} == {1}
    assert (got[1].longest, got[1].tiled, got[1].coverage) == (24, 24, 1.0) and got[2].tiled == 13
    half = leakage.leaks(spark.createDataFrame([(9, " ".join(w[12:] + ["gap"] + w[:12]))], "doc_id long, text string"), items, words=6).first()
    assert (half.longest, half.tiled) == (12, 24)
    assert leakage.leaks(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).count() == 0


def test_leaks_in_blocks_of_items_and_long_repetitive_texts(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"id{i} " + ITEM) for i in range(6)] + [(99, "a " * 200)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "z " * 5000 + ITEM), (2, "a " * 3000)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items, block_words=10).collect()}
    assert got == {(1, i) for i in range(6)} | {(2, 99)}


def test_tiles_are_greedy_and_do_not_overlap():
    item = np.arange(1, 31, dtype=np.uint64)
    doc = np.concatenate([item[10:30], item[0:15]])
    i, j = [], []
    for a in range(len(doc) - 4):
        for b in range(len(item) - 4):
            if (doc[a : a + 5] == item[b : b + 5]).all():
                i.append(a)
                j.append(b)
    assert leakage.tiles(doc, item, leakage.matches_of(doc, item, np.array(i), np.array(j), 5), 5) == [(20, 0, 10), (10, 20, 0)]


def test_matches_without_lists_of_seeds():
    rng = np.random.default_rng(7)
    for _ in range(40):
        doc, item = (rng.integers(0, 3, n).astype(np.uint64) for n in (rng.integers(5, 60), rng.integers(5, 40)))
        one, two = leakage.grams(doc, 4), leakage.grams(item, 4)
        i, j = np.nonzero(one[:, None] == two[None, :])
        listed = {tuple(x) for x in np.stack(leakage.matches_of(doc, item, i, j, 4), 1).tolist()}
        assert {tuple(x) for x in np.stack(leakage.matches_in(doc, item, 4), 1).tolist()} == listed


def test_broadcast_and_join_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words, 40))) for i in range(30)] + [(50, "la " * 60), (51, None), (50, "la " * 60)]
    docs = []
    for d in range(200):
        text = " ".join(rng.choice(words, 50)).split()
        if d % 3 == 0:
            own = items[d % 30][1].split()
            text[20:20] = own[20:] + own[:18]
        docs.append((d, " ".join(text)))
    docs += [(900, "la " * 5000), (901, None), (902, "")]
    one, two = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leakage, "PORTION", 500)
    wide, joined = ({tuple(r) for r in leakage.leaks(one, two, block_words=n).collect()} for n in (10**6, 10))
    assert wide == joined and len(wide) == 68 and (900, 50, 60, 60, 1.0) in wide
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(one, two, coverage=0.5).collect()} == {x[:2] for x in wide if x[4] >= 0.5}
