"""The pN_ queries and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import encode, leakage, neardup, overlap, pages, subjects, truncation, vectors
from lumenfold.queries import Registry
from lumenfold.sources.tables import table

R = Registry()


@R.register()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "passages"))


def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split, record_id, source, text, train) of the passages of a known split and of the locked questions."""
    split = F.lower(F.trim("split"))
    passages = table(spark, sf_dir, "passages").select(split.alias("split"), F.col("passage_id").alias("record_id"), F.col("text_source").alias("source"), "text")
    locked = table(spark, sf_dir, "se_locked").select(F.lit("locked").alias("split"), F.concat_ws(":", "site", F.col("question_id").cast("string")).alias("record_id"), F.col("site").alias("source"), "text")
    known = passages.where(F.col("split").isin("train", "val", "test")).unionByName(locked)
    return known.withColumn("train", (F.col("split") == "train").cast("int"))


@R.register()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = split_records(spark, sf_dir)
    leaked = overlap.overlapping(records).select(F.col("a").alias("sig")).distinct()
    named = records.where("train = 0").withColumn("record", F.struct("split", "record_id"))
    return neardup.bag_members(named, "record", "text").join(leaked, "sig", "left_semi").select("record.*").distinct()


@R.register()
def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every passage."""
    return neardup.near_duplicate_classes(table(spark, sf_dir, "passages"))


@R.register()
def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: evaluation records, and how many of them stand in the training split."""
    records = split_records(spark, sf_dir).where("train = 0").groupBy("split", "record_id").agg(F.max("source").alias("source"))
    marked = records.join(p2_found(spark, sf_dir).withColumn("found", F.lit(1)), ["split", "record_id"], "left")
    return marked.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("found").alias("overlapping"))


@R.register()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, sf_dir, "passage_vectors"))


@R.register()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign_subjects(table(spark, sf_dir, "passages"), table(spark, sf_dir, "taxonomy_subtopics"))


@R.register()
def p4_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each subject: those labelled with it and those it was assigned to."""
    passages = table(spark, sf_dir, "passages").select("passage_id", subjects.subject_of("general").alias("general"))
    given = passages.where("general is not null").distinct().groupBy("general").agg(F.count("*").alias("labelled"))
    new = p4_found(spark, sf_dir).groupBy("general").agg(F.count("*").alias("assigned"))
    return given.join(new, "general", "full").na.fill(0, ["labelled", "assigned"])


@R.register()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.spread_articles(table(spark, sf_dir, "passages"))


@R.register()
def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every article, with all articles of its page."""
    return pages.assign_splits(table(spark, sf_dir, "passages"))


@R.register()
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf_dir, "documents"))


@R.register()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


@R.register()
def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with its longest tile and its coverage of the item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


@R.register()
def p7_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks that cover half of the item or more, in whatever order its passages stand."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"), coverage=leakage.COVERED)


@R.register()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).where("truncated").select("doc_id")


@R.register()
def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source were cut."""
    return truncation.truncation_rates(table(spark, sf_dir, "documents"))
