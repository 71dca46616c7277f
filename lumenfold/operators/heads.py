"""Classifier heads over vectors: fitting with MLlib, calibration, decisions over two levels.

Rows carry `features` (array<double>) and class places; scores are arrays in label order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Matrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.vectors import argmax, dot, group_sums, let, places, softmax, within_group


def balanced_weights(rows: DataFrame, y: str) -> DataFrame:
    """`rows` with `weight` n/(classes * n of the class)."""
    counts = rows.groupBy(y).agg(F.count("*").alias("_n"))
    sizes = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(counts.crossJoin(sizes)), y).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


class Softmax:
    """A fitted multinomial head: coefficients and the class places they belong to."""

    def __init__(self, coefficients: list[list[float]], intercepts: list[float], classes: list[int], size: int):
        self.coefficients, self.intercepts, self.classes, self.size = coefficients, intercepts, classes, size

    def logits(self, features: Column) -> Column:
        """A logit for each of `size` classes; -Infinity for those never seen."""
        by = {c: dot(features, F.array(*map(F.lit, w))) + F.lit(b) for c, w, b in zip(self.classes, self.coefficients, self.intercepts)}
        return F.array(*(by.get(c, F.lit(float("-inf"))) for c in range(self.size)))


def fit_softmax(rows: DataFrame, features: str, y: str, c: float, size: int, iterations: int = 200) -> Softmax:
    """L2 multinomial logistic regression with balanced classes; regParam = 1/(C * sum of weights)."""
    classes = sorted(r[y] for r in rows.select(y).distinct().toLocalIterator())
    place = F.create_map(*(x for i, k in enumerate(classes) for x in (F.lit(k), F.lit(float(i)))))
    ready = balanced_weights(rows, y).select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.element_at(place, F.col(y)).alias("label"), "weight")
    total = ready.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=1 / (c * total), standardization=False, maxIter=iterations).fit(ready)
    matrix: Matrix = model.coefficientMatrix
    return Softmax(matrix.toArray().tolist(), list(model.interceptVector), classes, size)


def fit_multilabel(rows: DataFrame, features: str, target: str, labels: int, c: float) -> dict[int, Softmax]:
    """A two-class head for each label that has both classes; `target` is an array of 0 and 1."""
    out = {}
    for j in range(labels):
        own = rows.select(features, F.col(target)[j].alias("y"))
        if own.select("y").distinct().count() == 2:
            out[j] = fit_softmax(own, features, "y", c, 2)
    return out


def first_positive(target: Column) -> Column:
    """The 0-based place of the first 1 of an array of 0 and 1; 0 if there is none."""
    return argmax(target)


def fit_flat(rows: DataFrame, features: str, target: str, labels: int, c: float, iterations: int = 200) -> Softmax:
    """One softmax over all labels, the class of a row being its first positive one; labels never first get -Infinity."""
    return fit_softmax(rows.select(features, first_positive(F.col(target)).alias("y")), features, "y", c, labels, iterations)


def head_plan(rows: DataFrame, general: str, target: str, parents: list[int]) -> DataFrame:
    """(general, label, n, positives, fitted): the rows each label's head within its general topic would learn from.

    A head is fitted only where some rows of the general topic have the label and some do not. One aggregate.
    """
    sums = rows.where(F.col(general).isNotNull()).groupBy(F.col(general).alias("general")).agg(F.count("*").alias("n"), *(F.sum(F.col(target)[j].cast("long")).alias(f"p{j}") for j in range(len(parents))))
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("of"), F.lit(j).alias("label"), F.col(f"p{j}").alias("positives")) for j, g in enumerate(parents)))).alias("x")
    long = sums.select("general", "n", each).where(F.col("x.of") == F.col("general"))
    return long.select("general", "x.label", "n", "x.positives", ((F.col("x.positives") > 0) & (F.col("x.positives") < F.col("n"))).alias("fitted"))


def fit_hierarchical(rows: DataFrame, features: str, general: str, target: str, parents: list[int], c: float) -> dict[int, Softmax]:
    """A two-class head for each label, fitted on the rows of its general topic only; labels without both classes there have none."""
    plan = sorted((r.general, r.label) for r in head_plan(rows, general, target, parents).where("fitted").toLocalIterator())  # one row a label at most
    out = {}
    for g, j in plan:
        out[j] = fit_softmax(rows.where(F.col(general) == g).select(features, F.col(target)[j].alias("y")), features, "y", c, 2)
    return out


def similarity_probs(similarities: Column, sharpness: float = 0.05) -> Column:
    """Probabilities of labels from the cosines with their descriptions."""
    return softmax(similarities, sharpness)


def multilabel_probs(heads: dict[int, Softmax], features: Column, labels: int) -> Column:
    return F.array(*(softmax(heads[j].logits(features))[1] if j in heads else F.lit(0.0) for j in range(labels)))


class Margins:
    """Linear margins of each class against the rest, each with its own sigmoid; probabilities are these by their sum."""

    def __init__(self, classes: list[int], weights: list[list[float]], intercepts: list[float], sigmoids: list[tuple[float, float]]):
        self.classes, self.weights, self.intercepts, self.sigmoids = classes, weights, intercepts, sigmoids

    def margins(self, features: Column) -> list[Column]:
        return [dot(features, F.array(*map(F.lit, w))) + F.lit(b) for w, b in zip(self.weights, self.intercepts)]

    def probs(self, features: Column) -> Column:
        """Probabilities in the order of `classes`."""
        raw = F.array(*(1 / (1 + F.exp(-(F.lit(a) * m + F.lit(b)))) for m, (a, b) in zip(self.margins(features), self.sigmoids)))
        return let(raw, lambda r: let(F.aggregate(r, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(r, lambda x: x / total)))

    def predict(self, features: Column) -> Column:
        return F.array(*map(F.lit, self.classes))[argmax(self.probs(features))]


def fit_margins(rows: DataFrame, features: str, y: str, iterations: int = 50, held: int = 3) -> Margins:
    """Linear support vectors, one class against the rest with balanced weights, calibrated by sigmoids (Platt).

    The sigmoids are fitted on a `held`-th of the rows, chosen by hash, that the margins are
    not fitted on.
    """
    classes = sorted(r[y] for r in rows.select(y).distinct().toLocalIterator())
    ready = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(features).alias("f"), F.col(y).alias("c"), (F.pmod(F.xxhash64(F.col(features)), F.lit(held)) == 0).alias("apart")).persist()
    weights, intercepts, sigmoids = [], [], []
    try:
        for k in classes:
            own = ready.withColumn("label", (F.col("c") == k).cast("double"))
            model = LinearSVC(featuresCol="x", labelCol="label", weightCol="weight", maxIter=iterations, regParam=1e-4).fit(balanced_weights(own.where("not apart"), "label"))
            weights.append(model.coefficients.toArray().tolist())
            intercepts.append(float(model.intercept))
            margin = dot(F.col("f"), F.array(*map(F.lit, weights[-1]))) + F.lit(intercepts[-1])
            one = own.where("apart").select("label", array_to_vector(F.array(margin)).alias("x"))
            if one.select("label").distinct().count() < 2:
                sigmoids.append((1.0, 0.0))
                continue
            curve = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-6, standardization=False, maxIter=iterations).fit(one)
            sigmoids.append((float(curve.coefficients[0]), float(curve.intercept)))
    finally:
        ready.unpersist()
    return Margins(classes, weights, intercepts, sigmoids)


def fit_alternative(kind: str, rows: DataFrame, features: str, y: str):
    """naive_bayes, complement_naive_bayes (non-negative features), svm (calibrated margins), or majority."""
    if kind == "majority":
        return rows.groupBy(y).count().orderBy(F.desc("count"), y).first()[y]
    if kind == "svm":
        return fit_margins(rows, features, y)
    ready = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(y).cast("double").alias("label"))
    return NaiveBayes(modelType={"naive_bayes": "multinomial", "complement_naive_bayes": "complement"}[kind]).fit(ready)


def golden_section(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-4) -> float:
    """The place of the minimum of a function with one, by narrowing (low, high)."""
    share = (math.sqrt(5) - 1) / 2
    a, b = high - share * (high - low), low + share * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance:
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - share * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + share * (high - low)
            fb = f(b)
    return (low + high) / 2


def fit_temperature(rows: DataFrame, probability: Callable[[Column, float], Column], low: float = 0.05, high: float = 20.0) -> float:
    """The temperature of the least mean -log(probability(logits, T)); rows (logits, y), one aggregate a step."""
    kept = rows.select("logits", "y").persist()
    try:
        def loss(t: float) -> float:
            return kept.agg(F.avg(-F.log(F.greatest(probability(F.col("logits"), t), F.lit(1e-12))))).first()[0]

        return math.exp(golden_section(lambda s: loss(math.exp(s)), math.log(low), math.log(high), 1e-3))
    finally:
        kept.unpersist()


def true_probability(logits: Column, t: float) -> Column:
    return softmax(logits, t)[F.col("y")]


def true_group_probability(parents: list[int], groups: int) -> Callable[[Column, float], Column]:
    return lambda logits, t: group_sums(softmax(logits, t), parents, groups)[F.col("y")]


def grouped_probs(logits: Column, temperature: float, parents: list[int], groups: int) -> tuple[Column, Column]:
    """P(general) and P(subtopic | general) from subtopic logits."""
    subs = softmax(logits, temperature)
    return group_sums(subs, parents, groups), let(subs, lambda s: within_group(s, group_sums(s, parents, groups), parents))


def joint_probs(general: Column, within: Column, parents: list[int]) -> Column:
    return let(general, lambda g: F.zip_with(within, places(parents), lambda w, c: g[c] * w))


def decide_subtopics(probs: Column, parents: list[int], general: Column, threshold: float) -> Column:
    """0/1 for each subtopic: the first best child of the general topic, and its children from `threshold` on."""
    own = let(general, lambda g: F.zip_with(probs, places(parents), lambda p, c: F.when(c == g, p).otherwise(-1.0)))
    return let(own, lambda o: let(argmax(o), lambda best: F.transform(o, lambda x, j: ((j == best) | (x >= max(threshold, 0.0))).cast("int"))))


def reported_subtopics(probs: Column, parents: list[int], general: Column, threshold: float, most: int = 3) -> Column:
    """array<struct<ix, p>>: the best child and those from the threshold on, by falling probability, at most `most`."""
    chosen = F.arrays_zip(probs.alias("p"), decide_subtopics(probs, parents, general, threshold).alias("c"))
    numbered = F.transform(chosen, lambda s, j: F.struct((-s["p"]).alias("q"), j.alias("ix"), s["c"].alias("c")))
    kept = F.slice(F.array_sort(F.filter(numbered, lambda s: s["c"] == 1)), 1, max(1, most))
    return F.transform(kept, lambda s: F.struct(s["ix"].alias("ix"), (-s["q"]).alias("p")))
