"""Probabilities, decisions, metrics, detectors, fitting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import vectors as V
from lumenfold.operators import detectors, evaluation, heads, hierarchy
from lumenfold.plans.topic_model import fit_topic_model


def frame(spark, y, probs):
    return spark.createDataFrame([(int(a), [float(x) for x in p]) for a, p in zip(y, probs)], "y int, probs array<double>")


def random_probs(n, k, seed=0):
    p = np.random.default_rng(seed).dirichlet(np.ones(k), n)
    return np.random.default_rng(seed + 1).integers(0, k, n), p


def test_softmax_and_groups(spark):
    parents = hierarchy.parents()
    logits = np.random.default_rng(0).standard_normal((20, 28)) * 3
    logits[0, 3] = -np.inf
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(logits)], "i int, l array<double>")
    general, within = heads.grouped_probs(F.col("l"), 1.5, parents, 8)
    got = df.select("i", V.softmax(F.col("l"), 1.5).alias("p"), general.alias("g"), within.alias("w"), V.log_sum_exp(F.col("l"), 1.5).alias("e")).orderBy("i").collect()
    e = np.exp((logits - logits.max(1, keepdims=True)) / 1.5)
    p = e / e.sum(1, keepdims=True)
    assert np.allclose([r.p for r in got], p) and got[0].p[3] == 0
    g = np.stack([p[:, [j for j, q in enumerate(parents) if q == k]].sum(1) for k in range(8)], 1)
    assert np.allclose([r.g for r in got], g) and np.allclose([r.w for r in got], p / g[:, parents])
    assert np.allclose([r.e for r in got], 1.5 * np.log(np.exp(logits / 1.5).sum(1)))


def test_decisions(spark):
    probs = [0.1] * 28
    probs[1], probs[2], probs[4] = 0.5, 0.45, 0.9
    row = spark.createDataFrame([(probs, 0)], "p array<double>, g int")
    r = row.select(heads.decide_subtopics(F.col("p"), hierarchy.parents(), F.col("g"), 0.4).alias("d"), heads.reported_subtopics(F.col("p"), hierarchy.parents(), F.col("g"), 0.4, 1).alias("s"), heads.decide_subtopics(F.col("p"), hierarchy.parents(), F.lit(1), 2.0).alias("one")).first()
    assert [i for i, x in enumerate(r.d) if x] == [1, 2] and [(s.ix, s.p) for s in r.s] == [(1, 0.5)] and [i for i, x in enumerate(r.one) if x] == [4]


def test_multiclass_report(spark):
    y, p = random_probs(400, 5)
    y[y == 4] = 0  # a class that never comes
    r = evaluation.multiclass_report(frame(spark, y, p), 5).first()
    pred = p.argmax(1)
    assert r.accuracy == pytest.approx((pred == y).mean())
    assert r.log_loss == pytest.approx(-np.log(p[np.arange(400), y]).mean())
    assert r.brier == pytest.approx(((p - np.eye(5)[y]) ** 2).sum(1).mean())
    f1 = []
    for k in range(5):
        tp, said, true = ((pred == k) & (y == k)).sum(), (pred == k).sum(), (y == k).sum()
        f1.append(0 if not tp else 2 * tp / (said + true))
    assert r.macro_f1 == pytest.approx(np.mean(f1)) and r.weighted_f1 == pytest.approx(sum(f * (y == k).sum() for k, f in enumerate(f1)) / 400)
    conf, hit = p.max(1), (pred == y).astype(float)
    ece = sum(m.mean() * abs(hit[m].mean() - conf[m].mean()) for lo in range(15) if (m := (conf > lo / 15) & (conf <= (lo + 1) / 15)).any())
    assert r.ece == pytest.approx(ece)


def test_off_topic_report(spark):
    rng = np.random.default_rng(3)
    inside, outside = rng.integers(0, 12, 80) + 3.0, rng.integers(0, 12, 50) + 0.0
    df = spark.createDataFrame([(float(s), True) for s in inside] + [(float(s), False) for s in outside], "score double, inside boolean")
    r = evaluation.off_topic_report(df).first()
    wins = (inside[:, None] > outside).mean() + 0.5 * (inside[:, None] == outside).mean()
    assert r.auroc == pytest.approx(wins) and r.n_in == 80 and r.n_ood == 50
    assert r.fpr_at_95_tpr == pytest.approx((outside >= np.quantile(inside, 0.05)).mean())
    ap, seen = 0.0, 0
    for t in sorted(set(outside)):
        o, all_ = (outside <= t).sum(), (outside <= t).sum() + (inside <= t).sum()
        ap, seen = ap + (o - seen) / 50 * o / all_, o
    assert r.aupr_ood == pytest.approx(ap)


def test_multilabel_report(spark):
    rng = np.random.default_rng(4)
    y, pred, s = rng.integers(0, 2, (60, 6)), rng.integers(0, 2, (60, 6)), rng.random((60, 6))
    y[:, 5] = 0
    df = spark.createDataFrame([(a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(y, pred, s)], "y array<int>, pred array<int>, scores array<double>")
    r = evaluation.multilabel_report(df, 6).first()
    tp, su, sa = (y * pred).sum(0), y.sum(0), pred.sum(0)
    f = 2 * tp / (su + sa)
    assert r.micro_f1 == pytest.approx(2 * tp.sum() / (su + sa).sum()) and r.macro_f1 == pytest.approx(f.mean()) and r.labels_supported == 5
    assert r.hamming_loss == pytest.approx((y != pred).mean()) and r.subset_accuracy == pytest.approx((y == pred).all(1).mean())
    order = np.argsort(-s, 1)
    assert r.precision_at_1 == pytest.approx(y[np.arange(60), order[:, 0]].mean())
    assert r.recall_at_3 == pytest.approx(np.mean([y[i, order[i, :3]].sum() / max(1, y[i].sum()) for i in range(60)]))


def test_curves(spark):
    y, p = random_probs(200, 3, 7)
    curve = {r.threshold: r for r in evaluation.coverage_curve(frame(spark, y, p), [0.0, 0.6, 1.1]).collect()}
    assert curve[0.0].coverage == 1 and curve[1.1].coverage == 0 and curve[1.1].accuracy is None
    assert evaluation.largest_covering(spark.createDataFrame([(0.3, 0.95, 0.5), (0.4, 0.91, 0.5), (0.5, 0.5, 0.6)], "threshold double, coverage double, accuracy double")).first()[0] == 0.4
    top = evaluation.confusion_pairs(frame(spark, y, p), 3).collect()
    assert len(top) == 3 and top[0].n >= top[1].n >= top[2].n and all(r.y != r.pred for r in top)


def topical(n, seed=0, size=12, classes=3):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(9).standard_normal((classes, size)) * 2
    y = rng.integers(0, classes, n)
    return y, centres[y] + rng.standard_normal((n, size))


def vectors(spark, y, x):
    return spark.createDataFrame([(i, int(a), v.tolist()) for i, (a, v) in enumerate(zip(y, x))], "id int, label int, v array<double>")


def test_detectors_rank_known_above_noise(spark):
    y, x = topical(300)
    known = vectors(spark, y, x)
    noise = vectors(spark, np.zeros(100), np.random.default_rng(8).standard_normal((100, 12)) * 3)
    auc = lambda a, b: (np.array(a)[:, None] > np.array(b)).mean()
    means, precision = detectors.ledoit_wolf(known, "v", "label", 12)
    centred = x - np.stack([x[y == k].mean(0) for k in range(3)])[y]
    s = centred.T @ centred / 300
    assert np.allclose(np.linalg.inv(precision).trace(), s.trace()) and np.allclose(means, [x[y == k].mean(0) for k in range(3)])
    maha = [[r.score for r in detectors.mahalanobis_scores(df, "id", "v", means, precision).collect()] for df in (known, noise)]
    assert auc(*maha) > 0.9
    directions = detectors.class_means(known, "v", "label")
    cent = [[r.score for r in detectors.centroid_scores(df.withColumn("v", V.unit(F.col("v"))), "v", directions).collect()] for df in (known, noise)]
    assert auc(*cent) > 0.8
    knn = [[r.score for r in detectors.knn_scores(df, known, "id", "v", 5).collect()] for df in (known, noise)]
    assert auc(*knn) > 0.5 and len(knn[0]) == 300


def test_language_gate_and_routes(spark):
    rows = spark.createDataFrame([(1, ["known"], "fr", 0.9), (2, ["autre"], "fr", 0.6), (3, ["autre"], "fr", 0.4), (4, ["autre"], "en", 0.9), (5, [], "fr", 0.9), (6, ["un", "deux", "trois", "quatre", "cinq"], "fr", 0.35)], "id int, w array<string>, lang string, p double")
    lexicon = spark.createDataFrame([("known",)], "word string")
    got = {r.id: r.english for r in detectors.accepts_english(F.col("w"), lexicon, F.col("lang"), F.col("p"), {"1": 0.5, "2": 0.5, "3": 0.3, "4+": 0.3}, rows).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False}
    r = spark.range(1).select(*(detectors.route(*map(F.lit, a), 0.0, 0.5).alias(f"s{i}") for i, a in enumerate([(False, True, True, 1.0, 1.0), (True, False, True, 1.0, 1.0), (True, True, False, 1.0, 1.0), (True, True, True, -1.0, 1.0), (True, True, True, 1.0, 0.4), (True, True, True, 1.0, 0.5)]))).first()
    assert list(r) == ["uninformative", "non_english", "uninformative", "uncertain", "uncertain", "ok"]


def test_fits(spark):
    y, x = topical(300)
    rows = vectors(spark, y * 2, x)  # class 1 and 3 never come
    head = heads.fit_softmax(rows, "v", "label", 1.0, 6, 50)
    scored = rows.select("label", head.logits(F.col("v")).alias("l")).collect()
    assert np.mean([int(np.argmax(r.l)) == r.label for r in scored]) > 0.95 and scored[0].l[1] == -math.inf
    assert heads.golden_section(lambda t: (t - 2) ** 2, 0, 5) == pytest.approx(2, abs=1e-3)
    logits = np.random.default_rng(1).standard_normal((1500, 4)) * 2
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    truth = [int(np.random.default_rng(i).choice(4, p=q)) for i, q in enumerate(p)]
    df = spark.createDataFrame([(t, (3 * lo).tolist()) for t, lo in zip(truth, logits)], "y int, logits array<double>")
    assert heads.fit_temperature(df, heads.true_probability) == pytest.approx(3, abs=0.4)


def test_topic_model_end_to_end(spark):
    subs = [r[5] for r in hierarchy.taxonomy_rows()]
    of = {r[5]: r[1] for r in hierarchy.taxonomy_rows()}
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((28, 32)) * 2
    rows = [((centres[k] + rng.standard_normal(32)).tolist(), of[subs[k]], [subs[k]], i % 4) for i, k in enumerate(rng.integers(0, 28, 1200).tolist())]
    df = spark.createDataFrame(rows, "features array<double>, general string, subtopics array<string>, part int").cache()
    model = fit_topic_model(df.where("part > 1"), df.where("part = 1"), iterations=30)
    got = model.predict(df.where("part = 0").withColumnRenamed("general", "truth").withColumnRenamed("subtopics", "want")).collect()
    assert np.mean([r.general == r.truth for r in got]) > 0.9 and all(abs(sum(r.general_probs) - 1) < 1e-9 for r in got)
    assert np.mean([subs[r.subtopics[0].ix] == r.want[0] for r in got]) > 0.85 and {r.status for r in got} <= {"ok", "uncertain"}
    df.unpersist()
