"""Tables of sessions, results and cached answers, and the search payloads that fill them.

Spark enforces no keys, so constraints are queries that must find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import STORED_CHARS, SUMMARY_CHARS, TITLE_CHARS, clean_snippet, is_safe_url
from lumenfold.operators.corpus import latest

SCHEMA_VERSION = 1


class ConstraintError(ValueError):
    """Rows that break a key of a table."""


def require_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    if not rows.groupBy(*key).count().where("count > 1").isEmpty():
        raise ConstraintError(f"repeated {key}")
    return rows


def require_reference(rows: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    lost = rows.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    if not lost.isEmpty():
        raise ConstraintError(f"{column} without {key}")
    return rows


def require_version(stored: int) -> None:
    if stored > SCHEMA_VERSION:
        raise ConstraintError(f"version {stored} is newer than {SCHEMA_VERSION}")


def insert_or_ignore(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table with those of the new rows whose key it does not have."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key, new ones winning ties."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, key, [F.col(version), F.col("_new")]).drop("_new").select(*table.columns)


def cached(cache: DataFrame, now: Column, hours: float = 72) -> DataFrame:
    """The entries that are not older than their life."""
    return cache.where(F.col("fetched_at") >= now - F.make_interval(hours=F.lit(int(hours))))


def end_sessions(sessions: DataFrame, ended: DataFrame) -> DataFrame:
    """Sessions with their end, where they had none."""
    new = ended.select("session_id", F.col("ended_at").alias("_end"))
    return sessions.join(new, "session_id", "left").withColumn("ended_at", F.coalesce("ended_at", "_end")).drop("_end").select(*sessions.columns)


#: Tables of the store; nothing else is counted or written by name.
STORE = ("sessions", "texts", "conversation_topics", "search_results", "search_cache", "model_versions")


def text_rows(turns: DataFrame) -> DataFrame:
    """Rows of `texts` from (session, turn, text, status, general, confidence, subtopics array<struct>, general_probs map).

    Content is cut at STORED_CHARS, probabilities have 4 decimals, nested values are JSON;
    everything but status ok is uncertain.
    """
    rounded = F.transform_values("general_probs", lambda _, v: F.round(v, 4))
    subs = F.transform("subtopics", lambda s: F.struct(s["id"].alias("id"), F.round(s["probability"], 4).alias("probability")))
    return turns.select(
        F.col("session").cast("string").alias("session_id"), "turn", F.substring("text", 1, STORED_CHARS).alias("content"), F.col("general").alias("general_topic"), F.col("confidence").alias("general_confidence"),
        F.coalesce(F.to_json(subs), F.lit("[]")).alias("subtopics_json"), F.coalesce(F.to_json(rounded), F.lit("{}")).alias("general_probs_json"), (F.col("status") != "ok").cast("int").alias("uncertain"), "status",
    )


def topic_rows(themes: DataFrame, least: float = 0.01) -> DataFrame:
    """Rows of `conversation_topics` from (session, turn, label, phrase, scores map, sub_scores map, query).

    Scores have 4 decimals; subtopics below `least` are left out.
    """
    rounded = lambda c: F.transform_values(c, lambda _, v: F.round(v, 4))
    kept = F.map_filter("sub_scores", lambda _, v: v >= least)
    return themes.select(F.col("session").cast("string").alias("session_id"), "turn", "label", "phrase", F.to_json(rounded(F.col("scores"))).alias("general_scores_json"), F.to_json(rounded(kept)).alias("subtopic_scores_json"), F.coalesce("query", F.lit("")).alias("query"))


def result_rows(topics: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of `search_results`: the results (query, provider, rank, title, summary, url) of each topic's query; topics without results have none."""
    return topics.select("session_id", "turn", "query").join(found, "query").select("session_id", "turn", "query", "provider", "rank", "title", "summary", "url")


def session_texts(texts: DataFrame, session: str | None = None) -> DataFrame:
    """(session_id, turn, content, general_topic, subtopics, uncertain, status) in the order of turns, decoded; of one session or of all."""
    own = texts if session is None else texts.where(F.col("session_id") == session)
    decoded = F.from_json("subtopics_json", "array<struct<id:string,probability:double>>")
    return own.select("session_id", "turn", "content", "general_topic", decoded.alias("subtopics"), (F.col("uncertain") == 1).alias("uncertain"), "status").orderBy("session_id", "turn")


def counted(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """(n): the rows of a table of the store; other names raise."""
    if name not in STORE:
        raise ValueError(f"unknown table {name}")
    return tables[name].agg(F.count("*").alias("n"))


def migrated(table: DataFrame, stored: int, steps: list) -> DataFrame:
    """A stored table, brought from its version to that of `steps`, each a function of the table; newer versions are refused."""
    if stored > len(steps):
        raise ConstraintError(f"version {stored} is newer than {len(steps)}")
    for step in steps[stored:]:
        table = step(table)
    return table


def wikipedia_results(payloads: DataFrame, most: int = 3) -> DataFrame:
    """(id, rank, title, summary, url) from (id, payload JSON): pages by index, unsafe addresses dropped, ranks anew."""
    page = "struct<index:bigint,title:string,extract:string,fullurl:string>"
    listed = F.from_json(F.get_json_object("payload", "$.query.pages"), f"array<{page}>")
    mapped = F.map_values(F.from_json(F.get_json_object("payload", "$.query.pages"), f"map<string,{page}>"))
    pages = F.coalesce(F.when(F.get_json_object("payload", "$.query.pages").startswith("["), listed), mapped)
    each = payloads.select("id", F.posexplode(pages).alias("at", "p")).select("id", "at", F.coalesce("p.index", F.lit(1_000_000)).alias("ix"), clean_snippet(F.col("p.title"), TITLE_CHARS).alias("title"), clean_snippet(F.col("p.extract"), SUMMARY_CHARS).alias("summary"), F.col("p.fullurl").alias("url"))
    address = F.coalesce("url", F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.url_encode(F.replace(F.col("title"), F.lit(" "), F.lit("_")))))
    safe = each.withColumn("url", address).where((F.col("title") != "") & is_safe_url(F.col("url"), ("wikipedia.org",)))
    ranked = safe.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("ix", "at")))
    return ranked.where(F.col("rank") <= most).select("id", "rank", "title", "summary", "url")


def duckduckgo_results(payloads: DataFrame, most: int = 3) -> DataFrame:
    """(id, rank, title, summary, url): the abstract, then related topics with nested ones in place."""
    topic = "struct<Text:string,FirstURL:string>"
    schema = f"struct<Heading:string,AbstractText:string,AbstractURL:string,AbstractSource:string,RelatedTopics:array<struct<Text:string,FirstURL:string,Topics:array<{topic}>>>>"
    hosts = ("duckduckgo.com", "wikipedia.org")
    parsed = payloads.select("id", F.from_json("payload", schema).alias("j"))
    head = parsed.select("id", F.lit(-1).alias("at"), F.coalesce(F.nullif(clean_snippet(F.col("j.Heading"), TITLE_CHARS), F.lit("")), F.lit("Result")).alias("title"), clean_snippet(F.col("j.AbstractText"), SUMMARY_CHARS).alias("summary"), F.col("j.AbstractURL").alias("url"))
    flat = F.flatten(F.transform("j.RelatedTopics", lambda t: F.when(t["Topics"].isNotNull(), t["Topics"]).otherwise(F.array(F.struct(t["Text"].alias("Text"), t["FirstURL"].alias("FirstURL"))))))
    rest = parsed.select("id", F.posexplode(flat).alias("at", "t")).withColumn("summary", clean_snippet(F.col("t.Text"), SUMMARY_CHARS)).select("id", "at", F.substring(F.split("summary", " - ")[0], 1, TITLE_CHARS).alias("title"), "summary", F.col("t.FirstURL").alias("url"))
    safe = head.unionByName(rest).where((F.col("summary") != "") & is_safe_url(F.col("url"), hosts))
    ranked = safe.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    return ranked.where(F.col("rank") <= most).select("id", "rank", "title", "summary", "url")


def first_answer(candidates: DataFrame) -> DataFrame:
    """Of (id, priority, answered, n_results, cached): the first candidate that has results, else `no_results`.

    A cached empty answer counts as answered; without any answer the search is `offline`.
    Candidates whose provider cools down (`available`) should be gone before.
    """
    hit = F.min(F.when(F.col("n_results") > 0, F.struct("priority", "cached")))
    return candidates.groupBy("id").agg(hit.alias("h"), F.max("answered").alias("any")).select("id", F.when(F.col("h.cached"), "cached").when(F.col("h").isNotNull(), "ok").when(F.col("any"), "no_results").otherwise("offline").alias("status"), F.col("h.priority").alias("priority"))


def available(candidates: DataFrame, failures: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """The candidates whose provider has not failed within the last `seconds`; failures: (provider, failed_at). Cached ones always stay."""
    cooling = failures.groupBy("provider").agg(F.max("failed_at").alias("_failed"))
    met = candidates.join(F.broadcast(cooling), "provider", "left")  # a row a provider
    down = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("_failed") < seconds, F.lit(False))
    return met.where(F.col("cached") | ~down).drop("_failed")
