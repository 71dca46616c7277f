"""Profiles of texts and labels, vocabularies, hashed encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators.evaluation import quantile


def text_profile(rows: DataFrame) -> DataFrame:
    """One row: counts of rows, nulls and distinct texts, median and 95th percentile of words."""
    words = X.word_count(F.when(F.trim("text") != "", F.col("text"))).cast("double")
    counts = rows.agg(F.count("*").alias("rows"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{n}") for c, n in (("text", "text"), ("title", "title"), ("g", "general"), ("s", "split"))))
    distinct = rows.where("text is not null").select(F.sha2("text", 256).alias("k")).distinct().agg(F.count("*").alias("distinct_text"))
    found = quantile(rows.select(words.alias("words")), "words", [0.5, 0.95]).agg(*(F.round(F.max(F.when(F.col("share") == q, F.col("value"))), 6).alias(n) for q, n in ((0.5, "median_words"), (0.95, "p95_words"))))
    return counts.crossJoin(distinct).crossJoin(found)


def top_tokens(rows: DataFrame, group: str, text: str, n: int) -> DataFrame:
    """(group, token, n): the most frequent tokens of each group that are no stop words, ties by name."""
    stops = F.array(*map(F.lit, X.stop_words()))
    counted = rows.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z\-]+)"), 1)).alias("token")).where(~F.array_contains(stops, F.col("token"))).groupBy(group, "token").agg(F.count("*").alias("n"))
    return counted.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "token"))).where(F.col("r") <= n).drop("r")


def imbalance(rows: DataFrame, label: str) -> DataFrame:
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count("*").alias("classes"), F.round(F.max("n") / F.min("n"), 6).alias("imbalance"))


def repeat_rates(rows: DataFrame, group: str, text: str) -> DataFrame:
    """(group, rows, repeated, empty). Counts by (group, text digest) first, so a text of many rows is a few."""
    per = rows.groupBy(group, F.sha2(F.coalesce(text, F.lit("\0")), 256).alias("k")).agg(F.count("*").alias("c"), F.max((F.trim(F.coalesce(text, F.lit(""))) == "").cast("int")).alias("e"))
    all_ = per.groupBy("k").agg(F.sum("c").alias("n"))
    return per.join(all_, "k").groupBy(group).agg(F.sum("c").alias("rows"), (F.sum(F.when(F.col("n") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("repeated"), (F.sum(F.col("e") * F.col("c")) / F.sum("c")).alias("empty"))


def vocabulary(rows: DataFrame, identity: str, text: str, label: str, least: int = 3, size: int | None = None) -> DataFrame:
    """(word, weight): idf times the largest class share of the class shares; words in at least `least` texts.

    With `size`, the most frequent words only.
    """
    stops = F.array(*map(F.lit, X.stop_words()))
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stops, w))
    counts = rows.groupBy(label).agg(F.count("*").alias("nc"))
    total = counts.agg(F.sum("nc").alias("n"))
    per_text = rows.select(F.col(identity).alias("id"), label, F.explode(kept).alias("word")).groupBy("id", label, "word").agg(F.count("*").alias("tf"))
    per = per_text.groupBy("word", label).agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).join(F.broadcast(counts), label)
    share = F.col("df") / F.col("nc")
    summed = per.groupBy("word").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.max(share).alias("top"), F.sum(share).alias("all")).where(F.col("df") >= least)
    weighted = summed.crossJoin(F.broadcast(total)).withColumn("weight", F.round((F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1) * F.col("top") / F.col("all"), 4))
    return (weighted.orderBy(F.desc("tf"), "word").limit(size) if size else weighted).select("word", "weight")


def hashed_vectors(rows: DataFrame, identity: str, text: str, slots: int = 4096) -> DataFrame:
    """(id, slot, x): unit vectors of word counts, a word's slot being the end of its MD5; slots a power of 16."""
    digits = {16: 1, 256: 2, 4096: 3, 65536: 4}[slots]
    words = rows.select(F.col(identity).alias("_id"), F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)).alias("w"))
    counted = words.groupBy("_id", F.conv(F.substring(F.md5("w"), -digits, digits), 16, 10).cast("long").alias("slot")).agg(F.count("*").alias("n"))
    norms = counted.groupBy("_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counted.join(norms, "_id").select(F.col("_id").alias(identity), "slot", (F.col("n") / F.col("norm")).alias("x"))
