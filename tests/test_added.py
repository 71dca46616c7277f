"""Sources, saved models, encoders, sinks, samples, quantiles, simulation: goldens and edges."""

import io
import json
import urllib.error
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import conversation, corpus, detectors, evaluation, heads, store
from lumenfold.plans import encoders, lineage, simulation
from lumenfold.sources import client, files
from lumenfold.sources.tables import DataMissingError
from lumenfold.streaming.sessions import Sink


def test_models_are_saved_and_checked(spark, tmp_path):
    folder = str(tmp_path / "m")
    table = spark.createDataFrame([(1, 2.0)], "a int, b double")
    files.save_model(spark, folder, {"t": 1.5, "names": ["x", None]}, {"heads": table})
    model, tables = files.load_model(spark, folder, ["heads"])
    assert model == {"t": 1.5, "names": ["x", None]} and tables["heads"].collect() == table.collect()
    (tmp_path / "m" / "content" / "extra").write_text("x")
    with pytest.raises(files.TamperedError):
        files.load_model(spark, folder, ["heads"])
    with pytest.raises(files.TamperedError):
        files.save_model(spark, folder, {"t": object()}, {})


def test_locked_evaluations_run_once(spark, tmp_path):
    inputs = tmp_path / "in"
    inputs.mkdir()
    (inputs / "a.txt").write_text("one")
    frozen, results, report = str(tmp_path / "frozen"), str(tmp_path / "results"), spark.range(1)
    files.freeze(spark, str(inputs), frozen)
    with pytest.raises(files.FrozenError):
        files.freeze(spark, str(inputs), frozen)
    files.run_once(spark, str(inputs), frozen, results, report)
    with pytest.raises(files.FrozenError):
        files.run_once(spark, str(inputs), frozen, results, report)
    (inputs / "a.txt").write_text("two")
    with pytest.raises(files.FrozenError):
        files.run_once(spark, str(inputs), frozen, str(tmp_path / "again"), report)


def test_vectors_are_cached_by_tag_and_texts(spark, tmp_path):
    calls = []

    def encode(rows):
        calls.append(1)
        return rows.select("id", F.array(F.length("text").cast("double")).alias("features"))

    texts = spark.createDataFrame([(1, "a"), (2, "bb")], "id int, text string")
    for rows, tag in ((texts, "t"), (texts.orderBy(F.desc("id")), "t"), (texts.where("id = 1"), "t"), (texts, "u"), (texts, ""), (texts, "")):
        assert files.cached_by_digest(rows, "id", "text", tag, encode, str(tmp_path)).count() == rows.count()
    assert len(calls) == 5


def test_lines_and_words(spark, tmp_path):
    path = tmp_path / "s.txt"
    path.write_text("one\n\n  \r\ntwo\r\n")
    assert [r.text for r in files.lines_of(spark, str(path)).orderBy("at").collect()] == ["one", "two"]
    assert [r.text for r in files.given_lines(spark, io.StringIO("a\n\nb\n")).collect()] == ["a", "b"]
    assert files.given_lines(spark, []).count() == 0
    with pytest.raises(DataMissingError):
        files.lines_of(spark, str(tmp_path / "no"))
    files.write_words(spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "word string"), str(tmp_path / "w"))
    assert [r.word for r in files.read_words(spark, str(tmp_path / "w")).collect()] == ["a", "b"]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert files.read_words(spark, str(tmp_path / "none")).count() == 0 and seen


def test_client_tries_again():
    answers, waits = [urllib.error.HTTPError("u", 503, "", {"Retry-After": "7"}, None), urllib.error.HTTPError("u", 429, "", {}, None), OSError("x"), io.BytesIO(b'{"a": 1}')], []

    def opened(url, timeout):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert client.get_json("u", opened, waits.append) == {"a": 1} and waits[0] == 7 and len(waits) == 3
    for bad in (urllib.error.HTTPError("u", 404, "", {}, None), io.BytesIO(b"<html>"), io.BytesIO(b"1" * (client.MOST_BYTES + 1))):
        answers[:] = [bad]
        with pytest.raises(client.FetchError):
            client.get_json("u", opened, waits.append)


def test_pages_and_batches():
    rows = list(range(7))
    assert [x for page in client.pages(lambda n, at: rows[at : at + n], 3) for x in page] == rows
    assert list(client.pages(lambda n, at: [], 3)) == []

    def fetch(batch):
        if len(batch) > 2:
            raise client.FetchError("too many")
        return batch

    assert client.in_batches(rows, 5, fetch) == rows


def test_encoders(spark):
    own = encoders.encoder("hashed-256")
    rows = own.transform(spark.createDataFrame([("the river",), (None,), ("",)], "text string")).collect()
    assert abs(sum(x * x for x in rows[0].features) - 1) < 1e-9 and not any(rows[1].features) and len(rows[2].features) == 256
    one = spark.range(1)
    kept = encoders.probe(one, own)
    encoders.verify_encoder(one, own, kept)
    for wrong in (kept[::-1], kept[:5]):
        with pytest.raises(encoders.EncoderError):
            encoders.verify_encoder(one, own, wrong)
    with pytest.raises(encoders.EncoderError):
        encoders.encoder("none")
    both = encoders.concatenated(spark.createDataFrame([([1.0], [2.0])], "a array<double>, b array<float>"), ["a", "b"]).first()
    assert both.features == [1.0, 2.0]


def test_a_failing_store_does_not_stop_the_others(spark):
    taken = []

    def fails(batch, n):
        raise ValueError("full")

    sink = Sink({"bad": fails, "good": lambda batch, n: taken.append((n, batch.count()))})
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        sink(spark.range(3), 0)
        sink(spark.range(2), 1)
    assert taken == [(0, 3), (1, 2)] and sink.failures == {"bad": 2, "good": 0} and sink.history == [("bad", 0), ("bad", 1)]


def test_no_machine_local_checkpoints_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            sparkContext = Context()

            class conf:
                get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        lineage.cut(Frame())


def test_broadcast_is_decided_by_counted_rows(spark):
    joined = spark.range(4).withColumnRenamed("id", "a").join(spark.range(4).withColumnRenamed("id", "b"), F.col("a") == F.col("b")).groupBy("a").count()
    small, large = (lineage.broadcast_if_few(joined, n)._jdf.queryExecution().logical().toString() for n in (10, 3))
    assert "ResolvedHint" in small or "UnresolvedHint" in small
    assert "Hint" not in large


@pytest.mark.parametrize("values", [[], [1.0], [3.0, 1.0, None, 2.0, 2.0], np.random.default_rng(0).normal(size=400).round(1).tolist()])
def test_quantiles(spark, values):
    got = {r.share: r.value for r in evaluation.quantile(spark.createDataFrame([(v,) for v in values], "x double"), "x", [0.0, 0.05, 0.5, 1.0]).collect()}
    known = [v for v in values if v is not None]
    for share in (0.0, 0.05, 0.5, 1.0):
        assert got[share] == (pytest.approx(float(np.quantile(known, share))) if known else None)


def test_heads_within_general_topics(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        g, x = i % 2, rng.normal(size=2)
        rows.append((x.tolist(), g, [int(g == 0 and x[0] > 0), int(g == 0), int(g == 1 and x[1] > 0)]))
    df = spark.createDataFrame(rows, "features array<double>, g int, y array<int>")
    plan = {r.label: (r.general, r.n, r.fitted) for r in heads.head_plan(df, "g", "y", [0, 0, 1]).collect()}
    assert plan[0] == (0, 60, True) and plan[1] == (0, 60, False) and plan[2] == (1, 60, True)
    fitted = heads.fit_hierarchical(df, "features", "g", "y", [0, 0, 1], 4.0)
    assert set(fitted) == {0, 2}
    probs = df.select("g", "y", heads.multilabel_probs(fitted, F.col("features"), 3).alias("p")).collect()
    assert all(r.p[1] == 0 for r in probs) and np.mean([(r.p[0] > 0.5) == r.y[0] for r in probs if r.g == 0]) > 0.9


def test_off_topic_heads(spark):
    rng = np.random.default_rng(2)
    known = spark.createDataFrame([([float(k * 4), float(v)], k) for k in range(2) for v in rng.normal(size=40)], "v array<double>, y int")
    other = spark.createDataFrame([([float(v), 9.0],) for v in rng.normal(size=900)], "v array<double>")
    one = detectors.fit_in_domain(known, other, "v", 10.0)
    two = detectors.fit_other_class(known, other, "v", "y", 2, 10.0)
    for score in (lambda v: detectors.in_domain_score(one, v), lambda v: detectors.other_class_score(two, v)):
        inside, outside = (df.agg(F.avg(score(F.col("v")))).first()[0] for df in (known, other))
        assert inside > 0.8 > 0.3 > outside
    with pytest.raises(ValueError):
        detectors.fit_in_domain(known, other.limit(0), "v")


def test_text_forms(spark):
    row = spark.createDataFrame([("Poems@2", 'a "b"\\\n', "cell_biology", 0.1234)], "s string, t string, n string, p double").select(X.seed_of(F.col("s")).alias("s"), X.literal(F.col("t")).alias("t"), X.display(F.col("n")).alias("n"), X.best_guess(F.col("n"), F.col("p")).alias("g")).first()
    assert (row.s.name, row.s.depth) == ("Poems", 2) and row.t == '"a \\"b\\"\\\\\\n"' and row.n == "Cell Biology" and row.g == "cell_biology (12.3%)"


def test_texts_of_cases():
    cases = {"comment": "not this one", "cases": [{"id": "x y", "text": "one", "turns": ["two words", "single", {"text": "three", "note": "no no"}]}]}
    assert texts_equal(corpus.texts_of_cases(cases), ["one", "two words", "three"])
    assert corpus.texts_of_cases([]) == []


def texts_equal(got, want):
    return sorted(got) == sorted(want)


def test_contained_texts(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "xbcx"), (3, None), (None, "bc"), (1, "zz")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "bc"), (2, "abcd"), (3, ""), (4, None), (5, "bc")], "item_id long, text string")
    for most in (1, 100):
        got = {tuple(r) for r in corpus.contained(docs, items, "doc_id", "item_id", most=most).collect()}
        assert got == {(1, 1), (1, 5), (1, 2), (2, 1), (2, 5)}
    assert corpus.contained(docs.limit(0), items, "doc_id", "item_id").count() == corpus.contained(docs, items.limit(0), "doc_id", "item_id").count() == 0


def test_versions_and_cooling_providers(spark):
    table = spark.range(1)
    assert store.migrated(table, 1, [lambda t: 1 / 0, lambda t: t.withColumn("x", F.lit(1))]).columns == ["id", "x"]
    with pytest.raises(store.ConstraintError):
        store.migrated(table, 3, [lambda t: t])
    candidates = spark.createDataFrame([("a", "p", False), ("b", "p", True), ("c", "q", False), ("d", "r", False)], "id string, provider string, cached boolean")
    failures = spark.createDataFrame([("p", "2026-01-01 00:00:00"), ("q", "2025-12-31 23:50:00")], "provider string, failed_at string").withColumn("failed_at", F.to_timestamp("failed_at"))
    left = store.available(candidates, failures, F.lit("2026-01-01 00:01:00").cast("timestamp"))
    assert {r.id for r in left.collect()} == {"b", "c", "d"}
    with pytest.raises(ValueError):
        store.counted({"texts": table}, "passwords")
    assert store.counted({"texts": table}, "texts").first().n == 1


def test_stored_rows(spark):
    turns = spark.createDataFrame([("s", 1, "x" * 12_000, "ok", "physics", 0.9, [("relativity", 0.123456)], {"physics": 0.98765}), ("s", 2, None, "non_english", None, 0.0, None, None)], "session string, turn long, text string, status string, general string, confidence double, subtopics array<struct<id:string,probability:double>>, general_probs map<string,double>")
    rows = store.text_rows(turns).orderBy("turn").collect()
    assert len(rows[0].content) == 10_000 and json.loads(rows[0].general_probs_json) == {"physics": 0.9877} and rows[1].uncertain == 1
    back = store.session_texts(store.text_rows(turns), "s").collect()
    assert [r.turn for r in back] == [1, 2] and back[0].subtopics[0].probability == 0.1235 and back[1].subtopics == []


def test_strata_do_not_overlap(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(30)], "id int, odd int")
    got = corpus.strata_sample(rows, "id", {"all": F.lit(True), "odd": F.col("odd") == 1, "none": F.lit(False)}, 8).collect()
    assert len({r.id for r in got}) == len(got) == 16 and {r.stratum for r in got} == {"all", "odd"}
    assert corpus.strata_sample(rows.limit(0), "id", {"all": F.lit(True)}, 3).count() == 0


def test_simulation_chooses_an_eligible_rule(spark):
    pools = {t: [{k: 0.9 if k == t else 0.05 for k in "abc"}] for t in "abc"} | {None: [{k: 1 / 3 for k in "abc"}]}
    rules = [conversation.Rules(), conversation.Rules(expire_after=0), conversation.Rules(confirm_turns=1)]
    found = {(r.expire_after, r.confirm_turns): r for r in simulation.chosen_rules(simulation.simulated(spark, rules, pools, 40)).collect()}
    assert found[0, 2].stale_theme_rate == 1 and not found[0, 2].eligible and found[4, 2].stale_theme_rate == 0
    assert found[4, 1].false_switch_rate > found[4, 2].false_switch_rate and found[4, 2].eligible and found[4, 2].chosen
    assert simulation.simulated(spark, rules, {None: [{}]}, 5).count() == 0
