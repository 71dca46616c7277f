"""Scores of how well a vector fits the known topics, higher for better, and the gates made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.vectors import dot, log_sum_exp, softmax, unit
from lumenfold.operators.evaluation import quantile
from lumenfold.operators.heads import Softmax, fit_softmax
from lumenfold.plans.lineage import cut


def class_means(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, mean): the mean vector of each class. Sums of dimensions combine before the shuffle."""
    parts = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))
    means = parts.groupBy("label", "d").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))


def centroid_scores(rows: DataFrame, vector: str, means: DataFrame) -> DataFrame:
    """`rows` with `score`, the largest dot product with a class direction. One row a class is broadcast."""
    bank = means.agg(F.collect_list(unit(F.col("mean"))).alias("_bank"))
    return rows.crossJoin(F.broadcast(bank)).withColumn("score", F.array_max(F.transform("_bank", lambda c: dot(F.col(vector), c)))).drop("_bank")


def max_probability(probs: Column) -> Column:
    return F.array_max(probs)


def energy(logits: Column, temperature: float) -> Column:
    return log_sum_exp(logits, temperature)


def knn_scores(queries: DataFrame, bank: DataFrame, identity: str, vector: str, k: int = 10, most: int = 8000) -> DataFrame:
    """(id, score): mean of the `k` largest dot products with the bank.

    The bank is the `most` rows with the least hash of their identity, a bound, not the
    data: so it is broadcast, and the products are blocked matrix products in Arrow batches.
    """
    rows = bank.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(identity), identity).limit(most).select(F.col(vector).cast("array<double>").alias("v")).toPandas()
    matrix = np.stack(rows["v"].to_list()) if len(rows) else np.zeros((0, 1))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not len(matrix):
                yield pd.DataFrame({"id": batch["id"], "score": np.full(len(batch), np.nan)})
                continue
            dots = np.stack(batch["v"].to_list()) @ matrix.T
            n = min(k, dots.shape[1])
            yield pd.DataFrame({"id": batch["id"], "score": np.partition(dots, -n, axis=1)[:, -n:].mean(axis=1)})

    kept = queries.where(F.col(vector).isNotNull()).select(F.col(identity).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return kept.mapInPandas(score, T.StructType([T.StructField("id", kept.schema["id"].dataType), T.StructField("score", T.DoubleType())]))


def ledoit_wolf(rows: DataFrame, vector: str, label: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Class means and the precision matrix of the shrunk covariance of the centred vectors.

    Tasks return sums of x x' and of (x^2)(x^2)' of their rows, one small matrix each; the
    shrinkage is closed form on the driver.
    """
    means = {r.label: np.array(r["mean"]) for r in class_means(rows, vector, label).toLocalIterator()}
    order = sorted(means)
    table = np.stack([means[g] for g in order])
    place = {g: i for i, g in enumerate(order)}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first, second = 0, np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_list()) - table[[place[g] for g in batch["g"]]]
                n, first, second = n + len(x), first + x.T @ x, second + (x * x).T @ (x * x)
        yield pd.DataFrame({"n": [n], "first": [first.ravel().tolist()], "second": [second.ravel().tolist()]})

    kept = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("g"))
    added = kept.mapInPandas(sums, "n long, first array<double>, second array<double>").select("n", F.posexplode(F.arrays_zip("first", "second"))).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col.first").alias("f"), F.sum("col.second").alias("s")).orderBy("pos").toPandas()
    n = int(added["n"].iloc[0])
    covariance, fourth = added["f"].to_numpy().reshape(size, size) / n, added["s"].to_numpy().reshape(size, size)
    mu = np.trace(covariance) / size
    delta = ((covariance - mu * np.eye(size)) ** 2).sum() / size
    beta = min(max((fourth / n - covariance**2).sum() / (n * size), 0.0), delta)
    shrinkage = 0.0 if beta == 0 else beta / delta
    return table, np.linalg.inv((1 - shrinkage) * covariance + shrinkage * mu * np.eye(size))


def mahalanobis_scores(rows: DataFrame, identity: str, vector: str, means: np.ndarray, precision: np.ndarray) -> DataFrame:
    """(id, score): minus the least squared distance to a class mean."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_list())
            far = np.stack([np.einsum("nd,nd->n", (x - m) @ precision, x - m) for m in means], axis=1)
            yield pd.DataFrame({"id": batch["id"], "score": -far.min(axis=1)})

    kept = rows.where(F.col(vector).isNotNull()).select(F.col(identity).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return kept.mapInPandas(score, T.StructType([T.StructField("id", kept.schema["id"].dataType), T.StructField("score", T.DoubleType())]))


def quantile_threshold(rows: DataFrame, score: str, keep_out: float = 0.05) -> DataFrame:
    """(threshold): the exact interpolated quantile; null if there are no scores."""
    return quantile(rows, score, [keep_out]).select(F.col("value").alias("threshold"))


def accepts_english(words: Column, lexicon: DataFrame, lang: Column, confidence: Column, thresholds: dict[str, float], rows: DataFrame) -> DataFrame:
    """`rows` with `english`: true if all words are in the lexicon, or the language is not surely another.

    The lexicon is joined word by word, so it may have any size.
    """
    keyed = cut(rows.withColumn("_row", F.monotonically_increasing_id()))  # numbered once
    unknown = keyed.select("_row", F.explode(words).alias("word")).join(lexicon.select("word").distinct(), "word", "left_anti").groupBy("_row").agg(F.count("*").alias("_unknown"))
    n = F.size(words)
    bucket = F.when(n >= 4, "4+").otherwise(n.cast("string"))
    limit = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v)))), bucket), F.lit(1.1))
    return keyed.join(unknown, "_row", "left").withColumn("english", F.col("_unknown").isNull() | ~((lang != "en") & (confidence >= limit))).drop("_row", "_unknown")


def route(needs_check: Column, english: Column, informative: Column, score: Column, confidence: Column, least_score: float, least_confidence: float) -> Column:
    """ok, uncertain, non_english or uninformative, in the order of the gates."""
    return F.when(~needs_check, "uninformative").when(~english, "non_english").when(~informative, "uninformative").when((score < least_score) | (confidence < least_confidence), "uncertain").otherwise("ok")


def top_k_by_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)


def _share_of(rows: DataFrame, vector: str, n: int, most: int) -> DataFrame:
    """About `most` of the `n` rows, by the hash of the vector; all if there are no more."""
    share = min(1.0, most / max(1, n))
    return rows.where(F.pmod(F.xxhash64(F.col(vector)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows


def fit_in_domain(known: DataFrame, other: DataFrame, vector: str, c: float = 1.0, times: int = 3, iterations: int = 200) -> Softmax:
    """A two-class head, known against off-topic vectors, of which at most about `times` as many as known ones are used.

    The score is the probability of class 1. Without off-topic rows it raises.
    """
    here, there = known.count(), other.count()
    if not there:
        raise ValueError("off-topic rows are needed")
    both = known.select(vector, F.lit(1).alias("_y")).unionByName(_share_of(other, vector, there, times * here).select(vector, F.lit(0).alias("_y")))
    return fit_softmax(both, vector, "_y", c, 2, iterations)


def fit_other_class(known: DataFrame, other: DataFrame, vector: str, y: str, classes: int, c: float = 1.0, iterations: int = 200) -> Softmax:
    """A head over the known classes and one more for off-topic vectors; the score is 1 - P(the last)."""
    if other.isEmpty():
        raise ValueError("off-topic rows are needed")
    both = known.select(vector, F.col(y).alias("_y")).unionByName(other.select(vector, F.lit(classes).alias("_y")))
    return fit_softmax(both, vector, "_y", c, classes + 1, iterations)


def in_domain_score(head: Softmax, features: Column) -> Column:
    return softmax(head.logits(features))[1]


def other_class_score(head: Softmax, features: Column) -> Column:
    return 1 - softmax(head.logits(features))[head.size - 1]
