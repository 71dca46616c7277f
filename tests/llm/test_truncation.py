"""Truncated texts: held-out accuracy on cut texts, and edges."""

import numpy as np

from lumenfold.llm import truncation

SQL = "doc_id long, text string, lang string, source string, limited string"
NOUNS = "river engine window garden market letter method signal record planet".split()
VERBS = "follows carries explains divides measures reflects".split()


def prose(rng):
    return " ".join(f"The {rng.choice(NOUNS)} quietly {rng.choice(VERBS)} a {rng.choice(NOUNS)} near {rng.choice(NOUNS)}s." for _ in range(rng.integers(2, 6)))


def complete(rng):
    parts = [prose(rng)]
    kind = rng.integers(4)
    if kind == 0:
        parts += [f"- {rng.choice(NOUNS)} {rng.choice(NOUNS)}" for _ in range(4)]
    elif kind == 1:
        parts = [f"{rng.choice(NOUNS).title()} {rng.choice(NOUNS)}", prose(rng), "See also", *(f"{rng.choice(NOUNS).title()} {rng.choice(NOUNS)}" for _ in range(3))]
    elif kind == 2:
        parts.append("https://wiki.example/" + rng.choice(NOUNS))
    return "\n".join(parts)


def test_cut_texts_are_found(spark):
    rng = np.random.default_rng(0)
    rows, cut = [], set()
    for i in range(1500):
        text = complete(rng)
        if i % 10 == 0:
            text = prose(rng)
            at = int(rng.integers(len(text) // 2, len(text) - 2))
            while text[at - 1] in ". ":
                at -= 1
            text = text[:at]
            if not text.endswith("."):
                cut.add(i)
        rows.append((i, text, "en", "s", "x"))
    got = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, SQL)).where("truncated").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got & cut) >= 0.95 * len(got)


def test_forms(spark):
    rng = np.random.default_rng(1)
    known = [(1000 + i, complete(rng), "en", "s", "x") for i in range(300)]
    whole = ["All is said. It ends here.", "It ends \"here.\"", "x\n-- Some Name", "x\nhttps://a.example/b", "Press, 1999, pp. 12", "x\n***", "🙂", "(end)", "", "  \n", None, "x\nNames, list of the river, 1910"]
    early = ["The river quietly follows a gar", "The river quietly follows a garden near [...]", "The river follows …", "The river follows the&am", "The river follows the<br", "The river follows th�", 'The river follows <a title="' + "the longest of all titles " * 9, "The river quietly follows the method (continued)"]
    rows = known + [(i, t, None, None, "x") for i, t in enumerate(whole)] + [(500 + i, t, "EN", "s", "x") for i, t in enumerate(early)] + [(None, "The riv", "en", "s", "x"), (900, "The river follows. " * 50_000 + "The gar", "en", "s", "x")]
    got = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, SQL)).where("truncated").collect()}
    assert got & set(range(100)) == set()
    assert got & set(range(500, 600)) == set(range(500, 500 + len(early))) and 900 in got


def test_rates_and_limits(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (prose(rng) * 9)[:400] if i % 2 else prose(rng)[: 100 + i], "en", ["a", None][i % 3 == 0], "x") for i in range(200)]
    df = spark.createDataFrame(rows, SQL)
    limits = {(r.source, r.length) for r in truncation.length_limits(df).where("unit = 'chars'").collect()}
    assert limits == {("a", 400), (None, 400)}
    rates = {r.source: r for r in truncation.truncation_rates(df).collect()}
    assert rates["a"].documents == 133 and rates[None].documents == 67 and 0 < rates["a"].rate < 1
    assert truncation.truncation_rates(df.limit(0)).count() == 0


def test_texts_are_never_shuffled(spark):
    df = spark.createDataFrame([(i, f"The river follows. The garden {i}", "en", "s", "x") for i in range(50)], SQL)
    plan = truncation.truncated(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "text#" not in plan[: plan.index("MapInArrow")]


def test_abbreviations_get_a_threshold(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"The {rng.choice(NOUNS)} of Dr. {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)}s, vol. {rng.choice(NOUNS)} says." for _ in range(3)) + "\n" + prose(rng) + "\n" + prose(rng) for _ in range(1500)]
    rows = [(i, t, "en", "s", "x") for i, t in enumerate(texts)] + [(9000 + i, t[: t.index(" vol. ") + 5], "en", "s", "x") for i, t in enumerate(texts[:200])]
    got = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, SQL)).where("truncated").collect()}
    assert len([i for i in got if i >= 9000]) >= 190 and len([i for i in got if i < 9000]) <= 15
