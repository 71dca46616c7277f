"""Taxonomy, crawls, labels, splits, repeats, choices."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import corpus, hierarchy


def sha(t):
    return hashlib.sha1(t.encode()).hexdigest()


def test_taxonomy():
    rows = hierarchy.taxonomy_rows()
    assert len(rows) == 28 and len({r[1] for r in rows}) == 8 and hierarchy.parents()[:5] == [0, 0, 0, 0, 1]
    for bad in ({"a": ("domain", None, ("x",)), "b": ("domain", None, ("x",))}, {"a": ("role", None, ())}, {"a": ("domain", "z", ())}):
        with pytest.raises(hierarchy.TaxonomyError):
            hierarchy.taxonomy_rows(bad)


def test_encoding(spark):
    df = spark.createDataFrame([("physics", "relativity|astrophysics"), ("books", "relativity"), ("x", ""), (None, None)], "g string, s string")
    got = df.select(hierarchy.encode_general(F.col("g")).alias("g"), hierarchy.is_consistent(F.col("g"), hierarchy.subtopic_list("s")).alias("ok"), hierarchy.encode_subtopics(hierarchy.subtopic_list("s")).alias("b")).collect()
    assert [r.g for r in got] == [0, 5, None, None] and [r.ok for r in got] == [True, False, None, None]
    assert [i for i, b in enumerate(got[0].b) if b] == [1, 2] and sum(got[3].b) == 0


def test_crawl_takes_the_least_depth_and_does_not_expand_excluded(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "list_x"), ("list_x", "y"), ("c", "a"), ("c", "d"), ("a", "b")], "parent string, child string")
    seeds = spark.createDataFrame([("a",), ("list_x",)], "seed string")
    got = {(r.seed, r.node): (r.depth, r.excluded) for r in hierarchy.crawl(edges, seeds, 2, "^list_").collect()}
    assert got == {("a", "a"): (0, False), ("a", "b"): (1, False), ("a", "c"): (1, False), ("a", "list_x"): (1, True), ("a", "d"): (2, False), ("list_x", "list_x"): (0, False), ("list_x", "y"): (1, False)}


def test_labels(spark):
    m = spark.createDataFrame([("clear", "relativity", 0), ("clear", "genetics", 2), ("tie", "relativity", 1), ("tie", "genetics", 1), ("two", "relativity", 0), ("two", "astrophysics", 1), ("two", "classical_mechanics", 2)], "title string, subtopic string, depth int")
    got = {r.title: (r.general, r.subtopics, r.depth, r.ambiguous) for r in hierarchy.assign_labels(m, hierarchy.taxonomy(spark)).collect()}
    assert got == {"clear": ("physics", ["relativity"], 0, False), "tie": (None, None, 1, True), "two": ("physics", ["astrophysics", "relativity"], 0, False)}


def test_balanced_choice_and_splits(spark):
    titles = [f"t{i}" for i in range(23)]
    m = spark.createDataFrame([(t, "novels", i % 3) for i, t in enumerate(titles)], "title string, subtopic string, depth int")
    labelled = spark.createDataFrame([(t, "books", ["novels"]) for t in titles], "title string, general string, subtopics array<string>")
    got = {r.title for r in hierarchy.select_balanced(labelled, m, 5, spark.createDataFrame([("t0",)], "title string")).collect()}
    assert got == set(sorted((t for i, t in enumerate(titles) if i), key=lambda t: (titles.index(t) % 3, sha(t)))[:5])
    split = {r.title: r.split for r in hierarchy.assign_splits(labelled.unionByName(spark.createDataFrame([("x", None, ["p"]), ("y", None, ["p"])], labelled.schema))).collect()}
    order = sorted(titles, key=sha)
    n = round(23 * 0.15)
    assert [split[t] for t in order] == ["test"] * n + ["val"] * n + ["train"] * (23 - 2 * n) and split["x"] == split["y"] == "train"


@pytest.mark.parametrize(("n", "want"), [(10, 2), (30, 4), (3, 1), (2, 0)])
def test_split_sizes_round_half_to_even(spark, n, want):
    rows = spark.createDataFrame([(f"t{i}", "g", ["s"]) for i in range(n)], "title string, general string, subtopics array<string>")
    assert hierarchy.assign_splits(rows).where("split = 'test'").count() == want


def test_wilson(spark):
    df = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int")
    low, high = hierarchy.wilson(F.col("k"), F.col("n"))
    assert [tuple(r) for r in df.select(low, high).collect()] == [(0.4902, 0.9433), (0.0, 0.0)]


def test_latest_and_first(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), ("b", None, "n")], "k string, t int, v string")
    assert {tuple(r) for r in corpus.latest(rows, ["k"], [F.col("t")]).collect()} == {("a", 3, None), ("b", None, "n")}
    texts = spark.createDataFrame([("p2", "Same"), ("p1", "same"), ("p3", None), ("p4", None), ("p5", "other")], "id string, text string")
    assert {r.id for r in corpus.exact_first(texts, F.lower("text"), ["id"]).collect()} == {"p1", "p3", "p5"}


def test_near_duplicates(spark):
    base = "the element is one of the chemical elements in the second row of the periodic table".split()
    rows = [("t1", True, base), ("v1", False, base[:-1] + ["chart"]), ("v2", False, "nothing like it at all here".split()), ("v3", False, base), ("v4", False, [])]
    df = spark.createDataFrame(rows, "id string, fit boolean, w array<string>").withColumn("terms", corpus.word_terms(F.col("w")))
    got = {r.id: r.best for r in corpus.near_duplicates(df, "id", "terms", F.col("fit"), 0.9).collect()}
    assert set(got) == {"v1", "v3"} and got["v3"] == pytest.approx(1)
    assert corpus.near_duplicates(df.where("fit"), "id", "terms", F.col("fit")).count() == 0 == corpus.near_duplicates(df.where("not fit"), "id", "terms", F.col("fit")).count()


def test_near_duplicates_with_different_heaviest_terms(spark):
    rows = [("t1", True, ["x"] * 9 + ["y"] * 3), ("v1", False, ["x"] * 3 + ["y"] * 9), ("v2", False, ["y"] * 9 + ["x"] * 3), ("v3", False, ["x"]), ("t2", True, ["z"])]
    df = spark.createDataFrame(rows, "id string, fit boolean, terms array<string>")
    got = {r.id: r.best for r in corpus.near_duplicates(df, "id", "terms", F.col("fit"), 0.9).collect()}
    assert set(got) == {"v1", "v2"} and got["v1"] == got["v2"] > 0.9


def test_off_topic_titles_are_taken_once(spark):
    m = spark.createDataFrame([(t, s, c, 0) for t in "abcd" for s, c in (("val", "x"), ("test", "y"))] + [("e", "test", "y", 1)], "title string, split string, category string, depth int")
    got = corpus.off_topic_choice(m, [("val", "x"), ("test", "y")], 3).collect()
    first = sorted("abcd", key=sha)[:3]
    assert {r.title for r in got if r.split == "val"} == set(first)
    assert {r.title for r in got if r.split == "test"} == set("abcd") - set(first) | {"e"}


def test_recover_gives_a_page_to_one_title(spark):
    missing = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "title string")
    aliases = spark.createDataFrame([("B", "old"), ("C", "old"), ("C", "short"), ("D", "A")], "title string, alias string")
    dump = spark.createDataFrame([("A", 1, "x"), ("old", 2, "long text"), ("short", 3, "t"), ("used", 9, "u")], "title string, wiki_id long, text string")
    used = spark.createDataFrame([(9,)], "wiki_id long")
    assert {tuple(r) for r in corpus.recover(missing, aliases, dump, used).select("title", "wiki_id", "dump_title").collect()} == {("A", 1, "A"), ("B", 2, "old"), ("C", 3, "short")}


def test_transitions_and_overlaps(spark):
    old, new = (spark.createDataFrame(r, "k int, g string") for r in ([(1, "a"), (2, "b")], [(1, "c"), (3, "d")]))
    assert {tuple(r) for r in corpus.transitions(old, new, "k", "g").collect()} == {("a", "c", 1), ("b", None, 1), (None, "d", 1)}
    rows = spark.createDataFrame([("train", "x"), ("val", "x"), ("test", "x"), ("train", "y"), ("val", None)], "s string, k string")
    assert {tuple(r) for r in corpus.split_overlaps(rows, "s", "k").collect()} == {("test", "train", 1), ("test", "val", 1), ("train", "val", 1)}
