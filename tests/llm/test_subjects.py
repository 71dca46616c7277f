"""Subjects by topic models: held-out accuracy and edges."""

import numpy as np

from lumenfold.llm import subjects

SQL = "passage_id string, text string, general string, subtopics string, subject string"
TAXONOMY = [("optics", "physics"), ("waves", "physics"), ("novels", "books"), ("football", "sports")]
TERMS = {"optics": "lens prism photon mirror beam", "waves": "pulse crest trough sound echo", "novels": "chapter plot hero author page", "football": "goal striker pitch league referee"}


def sentence(rng, topic):
    own = TERMS[topic].split()
    return "The " + " near the ".join(own[i] for i in rng.integers(0, 5, 4)) + f" of Name{rng.integers(10**6)}."


def passages(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a = TAXONOMY[rng.integers(4)]
        b = TAXONOMY[rng.integers(4)] if rng.random() < 0.3 else a
        rows.append((f"{i}", sentence(rng, a[0]) + " " + sentence(rng, b[0]), a, {a[1], b[1]}))
    return rows


def test_hidden_labels_are_found(spark):
    rows = passages(600, 0)
    data = [(i, t, a[1].title() if int(i) % 3 else [None, " "][int(i) % 2], a[0], "x") for i, t, a, _ in rows]
    tax = spark.createDataFrame(TAXONOMY, "subtopic string, general string")
    got = {}
    for r in subjects.assign_subjects(spark.createDataFrame(data, SQL), tax).collect():
        got.setdefault(r.passage_id, set()).add(r.general)
    hidden = {i: want for i, _, _, want in rows if int(i) % 3 == 0}
    assert set(got) <= set(hidden)
    assert np.mean([got.get(i) == want for i, want in hidden.items()]) >= 0.95


def test_edges(spark):
    tax = spark.createDataFrame(TAXONOMY, "subtopic string, general string")
    rows = [("a", None, None, None, "x"), ("b", "", None, None, "x"), (None, "lens prism", None, None, "x"), ("c", "words of nothing", None, None, "x"), ("d", "goal", "unknown", "football", "x")]
    df = spark.createDataFrame(rows, SQL)
    assert subjects.assign_subjects(df, tax).count() == 0
    assert subjects.assign_subjects(df.limit(0), tax).count() == 0
    more = spark.createDataFrame([(i, t, a[1], a[0], "x") for i, t, a, _ in passages(200, 1)] + [("z", "lens prism photon " * 20_000, None, None, "x"), ("z", "lens prism photon", None, None, "x")], SQL)
    assert [(r.passage_id, r.general) for r in subjects.assign_subjects(more.unionByName(df), tax).collect()] == [("z", "physics")]


def test_digamma():
    x = np.array([0.05, 0.5, 1.0, 10.0])
    assert np.allclose(np.log(subjects.exp_digamma(x)), [-20.4978449, -1.9635100, -0.5772157, 2.2517526], atol=1e-5)
