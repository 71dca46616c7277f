"""From vectors to topics: fit a flat head over subtopics, calibrate it, set its gates, predict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.vectors import argmax
from lumenfold.operators import detectors, evaluation, heads, hierarchy
from lumenfold.operators.heads import Softmax

GRID = [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]


@dataclass
class TopicModel:
    head: Softmax
    temperature: float
    sub_threshold: float
    least_confidence: float
    least_score: float
    means: DataFrame

    def predict(self, rows: DataFrame, features: str = "features", english: Column | None = None) -> DataFrame:
        """`rows` with status, general, confidence, general_probs, subtopics and score.

        Rows not `english` have null general, no probabilities and confidence 0.
        """
        parents = hierarchy.parents()
        scored = detectors.centroid_scores(rows, features, self.means).withColumn("_logits", self.head.logits(F.col(features)))
        general, within = heads.grouped_probs(F.col("_logits"), self.temperature, parents, len(hierarchy.GENERALS))
        probs = scored.withColumn("_general", general).withColumn("_within", within).withColumns({"_top": argmax(F.col("_general")), "_conf": F.array_max("_general")})
        ok = F.lit(True) if english is None else english
        status = detectors.route(F.lit(True), ok, F.lit(True), F.col("score"), F.col("_conf"), self.least_score, self.least_confidence)
        names = F.array(*map(F.lit, hierarchy.GENERALS))
        subs = heads.reported_subtopics(F.col("_within"), parents, F.col("_top"), self.sub_threshold)
        decided = probs.withColumns({"status": status, "general": F.when(ok, names[F.col("_top")]), "confidence": F.when(ok, F.col("_conf")).otherwise(0.0), "general_probs": F.when(ok, F.col("_general")).otherwise(F.array().cast("array<double>")), "subtopics": F.when(ok, subs)})
        return decided.drop("_logits", "_general", "_within", "_top", "_conf")


def best_sub_threshold(rows: DataFrame, grid: list[float]) -> float:
    """Of rows (within, top, truth: arrays of 28, the general topic's place), the threshold of the best micro F1; ties to the lower.

    All thresholds are counted in one pass.
    """
    parents = hierarchy.parents()
    sums = []
    for k, t in enumerate(grid):
        chosen = heads.decide_subtopics(F.col("within"), parents, F.col("top"), t)
        both = F.aggregate(F.zip_with(chosen, F.col("truth"), lambda c, y: c * y), F.lit(0), lambda a, x: a + x)
        size = F.aggregate(F.zip_with(chosen, F.col("truth"), lambda c, y: c + y), F.lit(0), lambda a, x: a + x)
        sums += [F.sum(both).alias(f"h{k}"), F.sum(size).alias(f"s{k}")]
    row = rows.agg(*sums).first()
    f1 = [2 * row[f"h{k}"] / row[f"s{k}"] if row[f"s{k}"] else 0.0 for k in range(len(grid))]
    return grid[f1.index(max(f1))]


def fit_topic_model(train: DataFrame, val: DataFrame, c: float = 16.0, keep_out: float = 0.05, iterations: int = 100) -> TopicModel:
    """Fitted on train, calibrated on val; both (features, general, subtopics array<string>) of known labels.

    The head learns the first subtopic in label order; the temperature has the least loss of
    the general topic; the confidence threshold is the largest of GRID that answers 90 %;
    the gate keeps all but the `keep_out` quantile of val.
    """
    parents = hierarchy.parents()
    truth = hierarchy.encode_subtopics(F.col("subtopics"))
    labelled = train.withColumn("sub", argmax(truth))
    head = heads.fit_softmax(labelled, "features", "sub", c, len(parents), iterations)
    scored = val.select("features", hierarchy.encode_general(F.col("general")).alias("y"), truth.alias("truth"), head.logits(F.col("features")).alias("logits")).where("y is not null")
    temperature = heads.fit_temperature(scored, heads.true_group_probability(parents, len(hierarchy.GENERALS)))
    general, within = heads.grouped_probs(F.col("logits"), temperature, parents, len(hierarchy.GENERALS))
    decided = scored.select("y", "truth", general.alias("probs"), within.alias("within")).withColumn("top", argmax(F.col("probs")))
    confidence = evaluation.largest_covering(evaluation.coverage_curve(decided.select("y", "probs"), GRID)).first()[0]
    means = detectors.class_means(train, "features", "general")
    gate = detectors.quantile_threshold(detectors.centroid_scores(val, "features", means), "score", keep_out).first()[0]
    return TopicModel(head, temperature, best_sub_threshold(decided, GRID), confidence, gate, means)
