"""Other sources and sinks: JSON lines, nested and tagged questions, TSV, reports, manifests."""

from __future__ import annotations

import html
import json
import warnings
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.sources.tables import DataMissingError

PASSAGES = "passage_id string, wiki_id bigint, title string, general string, subtopics string, depth bigint, split string, text_source string, text string"
QUESTIONS = "source string, site string, question_id bigint, text string, tags array<string>, link string, score bigint, general string, subtopics array<string>, is_ood boolean, split string"


class TamperedError(ValueError):
    """Files that are not those of their manifest."""


def read_json_lines(spark: SparkSession, path: str, schema: str = QUESTIONS) -> DataFrame:
    """One object a line, by an explicit schema; lines that are no object raise."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise DataMissingError(path) from e
        raise


def read_any(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """parquet, csv (with header), jsonl or tsv."""
    if kind not in ("parquet", "csv", "jsonl", "tsv"):
        raise ValueError(f"unknown kind {kind}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "jsonl":
        return reader.json(path)
    return reader.csv(path, sep="\t" if kind == "tsv" else ",", header=kind == "csv", quote="" if kind == "tsv" else '"')


def sentences_tsv(spark: SparkSession, path: str, least: int = 2, most: int = 25) -> DataFrame:
    """(id, lang, text) of a (compressed) TSV, texts of `least` to `most` words."""
    rows = read_any(spark, path, "tsv", "id string, lang string, text string")
    return rows.where(F.size(F.split(F.trim("text"), r"\s+")).between(least, most))


def tagged_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, title, tags, link, score) of saved answers {items: [...]}; titles without entities, trimmed."""

    @F.pandas_udf(T.StringType())
    def plain(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: html.unescape(t).strip(), na_action="ignore")

    item = "struct<question_id:bigint,title:string,tags:array<string>,link:string,score:bigint>"
    return spark.read.schema(f"items array<{item}>").option("multiLine", True).json(path).select(F.explode("items").alias("i")).select("i.question_id", plain("i.title").alias("title"), "i.tags", "i.link", "i.score")


def cluster_titles(spark: SparkSession, path: str, sites: DataFrame) -> DataFrame:
    """(site, text, general, is_ood) of lines {sentences, labels}: one row a distinct site and text, of known sites.

    sites: (site, general); a null general marks off-topic ones. Lines whose lists differ in length raise.
    """
    lines = spark.read.schema("sentences array<string>, labels array<string>").json(path)
    paired = F.when(F.size("sentences") == F.size("labels"), F.arrays_zip("sentences", "labels")).otherwise(F.raise_error(F.lit("sentences and labels differ in length")).cast("array<struct<sentences:string,labels:string>>"))
    rows = lines.select(F.explode(paired).alias("x")).select(F.col("x.labels").alias("site"), F.col("x.sentences").alias("text")).distinct()
    return rows.join(sites, "site").select("site", "text", "general", F.col("general").isNull().alias("is_ood"))


def articles_of(dump: DataFrame, wanted: DataFrame, limit: int = 12_000) -> DataFrame:
    """(title, wiki_id, text) of a dump (title, wiki_id, text, shard): wanted by title or id, the last shard's row of a title.

    Titles match exactly; other letter cases are other pages. Texts are cut at `limit`.
    """
    by_title = dump.join(wanted.select("title").where("title is not null").distinct(), "title", "left_semi")
    by_id = dump.join(wanted.select("wiki_id").where("wiki_id is not null").distinct(), "wiki_id", "left_semi")
    both = by_title.select("title", "wiki_id", "text", "shard").unionByName(by_id.select("title", "wiki_id", "text", "shard"))
    return both.groupBy("title").agg(F.max(F.struct("shard", "wiki_id", "text")).alias("x")).select("title", "x.wiki_id", F.substring("x.text", 1, limit).alias("text"))


def aliases_of(redirects: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, aliases): the sorted old titles that lead to each of `titles`."""
    return redirects.join(titles.select("title").distinct(), "title", "left_semi").groupBy("title").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))


def fan_out(rows: DataFrame, split: str, splits: list[str], in_general: Column | None = None) -> dict[str, DataFrame]:
    """A filtered view for each split; with `in_general` also those rows of each as `<split>_general`. One scan each, nothing computed yet."""
    own = {s: rows.where(F.col(split) == s) for s in splits}
    return own if in_general is None else own | {f"{s}_general": df.where(in_general) for s, df in own.items()}


def without_intents(rows: DataFrame, intent: str, excluded: list[str], splits: dict[str, str], split: str = "split") -> DataFrame:
    """Rows of no excluded intent, their splits named anew; rows of unknown splits and of null intents are dropped."""
    names = F.create_map(*(F.lit(x) for pair in splits.items() for x in pair))
    return rows.where(~F.col(intent).isin(excluded)).withColumn(split, F.try_element_at(names, F.col(split))).where(F.col(split).isNotNull())


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(at, text): the lines of a file that are not blank, in order; DataMissingError if it is not there."""
    if not Path(path.removeprefix("file://")).exists() and "://" not in path.removeprefix("file://"):
        raise DataMissingError(path)
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("at", "text")).where(F.trim("text") != "")


def given_lines(spark: SparkSession, lines) -> DataFrame:
    """(at, text) of an open stream such as standard input, or of any strings; blank lines are left out."""
    kept = [(n, line.rstrip("\r\n")) for n, line in enumerate(lines) if line.strip()]
    return spark.createDataFrame(kept, "at int, text string")


def write_words(words: DataFrame, path: str) -> None:
    """A lexicon: one word a line, sorted; replaces what is there."""
    words.select(F.col("word").alias("value")).where("value IS NOT NULL").distinct().sort("value").write.mode("overwrite").text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a lexicon; an empty table, with a warning, if it is not there."""
    try:
        return spark.read.text(path).select(F.col("value").alias("word")).where("word <> ''")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        warnings.warn(f"no words at {path}", stacklevel=2)
        return spark.createDataFrame([], "word string")


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A (small or large) report as parquet, csv with a header, JSON lines, or lines of text (one column); replaces what is there.

    A csv of no rows is an empty file.
    """
    writer = rows.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", not rows.isEmpty()).csv(path)
    elif kind == "text":
        writer.text(path)
    elif kind in ("json", "parquet"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = Path(folder).resolve().as_posix()
    return files.select(F.regexp_replace(F.col("path"), "^.*" + root.replace(".", r"\.") + "/", "").alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, folder: str, expected: DataFrame) -> None:
    """Raises if a file is missing, extra or changed."""
    there = manifest(spark, folder)
    both = expected.select("name", F.col("size").alias("s"), F.col("sha256").alias("h")).join(there, "name", "full")
    bad = both.where(F.col("s").isNull() | F.col("size").isNull() | (F.col("h") != F.col("sha256")) | (F.col("s") != F.col("size"))).select("name").limit(5).collect()
    if bad:
        raise TamperedError(", ".join(r.name for r in bad))


def fingerprint(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, digest): the same for the same rows in any order and partitioning."""
    own = F.sha2(F.to_json(F.struct(*(columns or sorted(rows.columns)))), 256)
    parts: list[Column] = [F.sum(F.conv(F.substring(own, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    summed = rows.agg(F.count("*").alias("rows"), *parts)
    return summed.select("rows", F.substring(F.sha2(F.concat_ws(",", *(F.col(f"p{i}").cast("string") for i in range(8))), 256), 1, 16).alias("digest"))


#: Kinds of values that a saved model may hold.
PLAIN = (str, int, float, bool, type(None))


def _plain(value, place: str = "model") -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _plain(k, place), _plain(v, f"{place}.{k}")
    elif isinstance(value, list):
        for n, v in enumerate(value):
            _plain(v, f"{place}[{n}]")
    elif not isinstance(value, PLAIN):
        raise TamperedError(f"{place} is a {type(value).__name__}")


def save_model(spark: SparkSession, folder: str, model: dict, tables: dict[str, DataFrame]) -> None:
    """A model of plain values and tables, with a manifest beside it that `load_model` checks; replaces what is there."""
    _plain(model)
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/content/model")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/content/{name}")
    manifest(spark, f"{folder}/content").write.mode("overwrite").parquet(f"{folder}/manifest")


def load_model(spark: SparkSession, folder: str, names: list[str]) -> tuple[dict, dict[str, DataFrame]]:
    """The model and its tables; TamperedError if any file is changed, missing or extra, or a value is not plain."""
    verify(spark, f"{folder}/content", spark.read.parquet(f"{folder}/manifest"))
    model = json.loads(spark.read.option("wholetext", True).text(f"{folder}/content/model").first()["value"])
    _plain(model)
    return model, {n: spark.read.parquet(f"{folder}/content/{n}") for n in names}


class FrozenError(RuntimeError):
    """An evaluation that was run before, or whose inputs are not those that were frozen."""


def freeze(spark: SparkSession, folder: str, path: str) -> None:
    """Writes the manifest of a folder once; a second time is refused."""
    try:
        manifest(spark, folder).write.mode("error").parquet(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        raise FrozenError(f"{path} is there") from e


def run_once(spark: SparkSession, folder: str, frozen: str, results: str, report: DataFrame) -> None:
    """Writes the report of a locked evaluation, if the folder is as it was frozen and no results are there yet."""
    try:
        verify(spark, folder, spark.read.parquet(frozen))
    except TamperedError as e:
        raise FrozenError(str(e)) from e
    try:
        report.write.mode("error").parquet(results)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        raise FrozenError(f"{results} is there") from e


def cached_by_digest(texts: DataFrame, identity: str, text: str, tag: str, encode, folder: str) -> DataFrame:
    """(`identity`, features) by encode((`identity`, text)), kept in `folder` under the encoder's tag and the digest of the texts.

    Other weights have another tag and other texts another digest, so stale vectors are never read. No tag, no cache.
    """
    own = texts.select(F.col(identity), F.col(text).alias("text"))
    if not tag:
        return encode(own)
    path = f"{folder}/{tag}-{fingerprint(own).first()['digest']}"
    try:
        return texts.sparkSession.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    encode(own).write.mode("overwrite").parquet(path)
    return texts.sparkSession.read.parquet(path)
