"""Stored tables, search payloads, files, settings."""

import json

import pytest
from pyspark.sql import functions as F

from lumenfold import settings
from lumenfold.operators import store
from lumenfold.sources import files
from lumenfold.sources.tables import DataMissingError, table


def test_constraints(spark):
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "id int, ref int")
    parent = spark.createDataFrame([(1,)], "id int")
    store.require_unique(rows, ["id"])
    store.require_reference(rows, "ref", parent, "id")
    with pytest.raises(store.ConstraintError):
        store.require_unique(rows, ["ref"])
    with pytest.raises(store.ConstraintError):
        store.require_reference(rows, "id", parent, "id")
    with pytest.raises(store.ConstraintError):
        store.require_version(2)


def test_writes(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "id int, v string, t int")
    assert {tuple(r) for r in store.upsert(t, new, ["id"], "t").collect()} == {(1, "c", 1), (2, "b", 5), (3, "e", 1)}
    assert {tuple(r) for r in store.insert_or_ignore(t, new, ["id"]).collect()} == {(1, "a", 1), (2, "b", 5), (3, "e", 1)}
    sessions = spark.createDataFrame([("x", None), ("y", "then")], "session_id string, ended_at string")
    ended = spark.createDataFrame([("x", "now"), ("y", "now")], "session_id string, ended_at string")
    assert {tuple(r) for r in store.end_sessions(sessions, ended).collect()} == {("x", "now"), ("y", "then")}
    cache = spark.sql("SELECT timestamp'2026-01-04 00:00:00' fetched_at UNION ALL SELECT timestamp'2026-01-01 00:00:01' UNION ALL SELECT timestamp'2025-12-31 00:00:00'")
    assert store.cached(cache, F.expr("timestamp'2026-01-04 00:00:00'"), 72).count() == 2


def test_payloads(spark):
    wiki = {"query": {"pages": [{"index": 2, "title": "B", "extract": "<b>b</b> &amp; c", "fullurl": "https://en.wikipedia.org/wiki/B"}, {"index": 1, "title": "A", "extract": None}, {"title": "Last", "fullurl": "https://evil.org"}, {"index": 3, "title": ""}]}}
    old = {"query": {"pages": {"7": {"index": 1, "title": "X y", "extract": "e"}}}}
    df = spark.createDataFrame([(1, json.dumps(wiki)), (2, json.dumps(old)), (3, "not json"), (4, "[]"), (5, None)], "id int, payload string")
    got = [tuple(r) for r in store.wikipedia_results(df).orderBy("id", "rank").collect()]
    assert got == [(1, 1, "A", "", "https://en.wikipedia.org/wiki/A"), (1, 2, "B", "b & c", "https://en.wikipedia.org/wiki/B"), (2, 1, "X y", "e", "https://en.wikipedia.org/wiki/X_y")]
    duck = {"Heading": "H", "AbstractText": "abs", "AbstractURL": "https://duckduckgo.com/h", "RelatedTopics": [{"Text": "one - two", "FirstURL": "https://duckduckgo.com/1"}, {"Name": "n", "Topics": [{"Text": "deep", "FirstURL": "https://duckduckgo.com/2"}]}, {"Text": "bad", "FirstURL": "http://duckduckgo.com/3"}]}
    df = spark.createDataFrame([(1, json.dumps(duck)), (2, "{}"), (3, "x")], "id int, payload string")
    got = [(r.id, r["rank"], r.title, r.summary) for r in store.duckduckgo_results(df).orderBy("id", "rank").collect()]
    assert got == [(1, 1, "H", "abs"), (1, 2, "one", "one - two"), (1, 3, "deep", "deep")]


def test_first_answer(spark):
    rows = spark.createDataFrame([(1, 0, True, 0, False), (1, 1, True, 3, True), (1, 2, True, 5, False), (2, 0, True, 0, True), (3, 0, False, 0, False), (4, 1, True, 2, False)], "id int, priority int, answered boolean, n_results int, cached boolean")
    assert {r.id: (r.status, r.priority) for r in store.first_answer(rows).collect()} == {1: ("cached", 1), 2: ("no_results", None), 3: ("offline", None), 4: ("ok", 1)}


def test_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"site": "a", "text": "t", "tags": ["x"]}\n')
    assert files.read_json_lines(spark, str(tmp_path / "q.jsonl")).first().tags == ["x"]
    with pytest.raises(DataMissingError):
        files.read_json_lines(spark, str(tmp_path / "none.jsonl")).collect()
    with pytest.raises(DataMissingError):
        table(spark, str(tmp_path), "none")
    (tmp_path / "s.tsv").write_text('1\ten\tone "two three\n2\ten\tone\n')
    assert [r.text for r in files.sentences_tsv(spark, str(tmp_path / "s.tsv")).collect()] == ['one "two three']
    (tmp_path / "tags.json").write_text(json.dumps({"items": [{"question_id": 5, "title": " a &lt; b ", "tags": ["t"]}]}))
    assert files.tagged_questions(spark, str(tmp_path / "tags.json")).first().title == "a < b"
    (tmp_path / "c.jsonl").write_text('{"sentences": ["p", "q", "p"], "labels": ["s1", "s2", "s1"]}\n')
    sites = spark.createDataFrame([("s1", "physics"), ("s2", None)], "site string, general string")
    assert {tuple(r) for r in files.cluster_titles(spark, str(tmp_path / "c.jsonl"), sites).collect()} == {("s1", "p", "physics", False), ("s2", "q", None, True)}
    with pytest.raises(ValueError):
        files.read_any(spark, "x", "xml")


def test_dump_and_aliases(spark):
    dump = spark.createDataFrame([("A", 1, "old", 0), ("A", 1, "new", 1), ("a", 2, "other", 0), ("B", 3, "x" * 13_000, 0)], "title string, wiki_id long, text string, shard int")
    wanted = spark.createDataFrame([("A", None), (None, 3)], "title string, wiki_id long")
    assert {r.title: len(r.text) for r in files.articles_of(dump, wanted).collect()} == {"A": 3, "B": 12_000}
    redirects = spark.createDataFrame([("T", "z"), ("T", "y"), ("T", "z"), ("U", "q")], "title string, alias string")
    assert files.aliases_of(redirects, spark.createDataFrame([("T",)], "title string")).first().aliases == ["y", "z"]


def test_manifest_and_reports(spark, tmp_path):
    folder = tmp_path / "artifact"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    (folder / "b.txt").write_text("two")
    stored = files.manifest(spark, str(folder)).collect()
    assert {r["name"] for r in stored} == {"a.txt", "b.txt"}
    expected = spark.createDataFrame(stored)
    files.verify(spark, str(folder), expected)
    (folder / "c.txt").write_text("extra")
    with pytest.raises(files.TamperedError):
        files.verify(spark, str(folder), expected)
    rows = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    for kind in ("csv", "json", "parquet"):
        files.write_report(rows, str(tmp_path / kind), kind)
        assert files.read_any(spark, str(tmp_path / kind), {"json": "jsonl"}.get(kind, kind)).count() == 2
    same = files.fingerprint(rows.orderBy("x").repartition(3)).first()
    assert same == files.fingerprint(rows.orderBy(F.desc("x"))).first() and same != files.fingerprint(rows.limit(1)).first()


def test_settings():
    got = settings.load(environment={"LUMENFOLD_DECAY": "0.5", "LUMENFOLD_OFFLINE": "Yes", "LUMENFOLD_MIN_CONFIDENCE": "model", "LUMENFOLD_RESULTS": "7"}, results=2)
    assert (got.decay, got.offline, got.min_confidence, got.results) == (0.5, True, None, 2)
