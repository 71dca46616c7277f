"""Queries over predictions and vectors: probabilities, decisions, detectors, metrics.

Predictions are made of `embeddings`: scaled coordinates are the logits, `label` the truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import vectors as V
from lumenfold.operators import detectors, evaluation, heads, hierarchy, profile
from lumenfold.plans import topic_model
from lumenfold.plans.lineage import cut
from lumenfold.queries import Registry, corpora
from lumenfold.sources import files
from lumenfold.sources.tables import table

R = Registry()
CLASSES = 10
_PRED = """l AS (SELECT vec_id, label AS y, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 10) AS l FROM embeddings),
ex AS (SELECT vec_id, y, l, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM l), pr AS (SELECT vec_id, y, l, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM ex),
dec AS (SELECT *, list_position(probs, list_max(probs)) - 1 AS pred, list_max(probs) AS conf, CASE WHEN list_position(probs, list_max(probs)) - 1 = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM pr)"""


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, y, logits, probs)."""
    logits = F.transform(F.slice("x", 1, CLASSES), lambda x: x * 10.0)
    return embeddings(spark, d).select("vec_id", F.col("label").alias("y"), logits.alias("logits")).withColumn("probs", V.softmax(F.col("logits")))


_SUBS = f"""l AS (SELECT vec_id, label, list_transform(embedding[1:28], lambda x: CAST(x AS DOUBLE) * 10) AS l FROM embeddings), ex AS (SELECT vec_id, label, list_transform(l, lambda x: exp((x - list_max(l)) / 1.4279)) AS e FROM l),
sub AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex), long AS (SELECT vec_id, label, unnest(range(0, 28)) AS j, unnest(p) AS p FROM sub),
par AS (SELECT unnest(range(0, 28)) AS j, unnest({hierarchy.parents()}) AS g), lg AS (SELECT vec_id, label, j, g, p, sum(p) OVER (PARTITION BY vec_id, g ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS pg FROM long JOIN par USING (j))"""


def subtopic_probs(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, general, within) by a flat head over 28 subtopics."""
    logits = F.transform(F.slice("x", 1, 28), lambda x: x * 10.0)
    general, within = heads.grouped_probs(F.col("logits"), 1.4279, hierarchy.parents(), 8)
    return embeddings(spark, d).select("vec_id", logits.alias("logits")).select("vec_id", general.alias("general"), within.alias("within"))


@R.register(f"WITH {_SUBS} SELECT vec_id, g::BIGINT AS g, round(any_value(pg), 6) AS p FROM lg GROUP BY ALL")
def m14_grouped(spark, d):
    """P(general) of every vector."""
    return subtopic_probs(spark, d).select("vec_id", F.posexplode("general").alias("g", "p")).select("vec_id", F.col("g").cast("long").alias("g"), F.round("p", 6).alias("p"))


@R.register(f"WITH {_SUBS} SELECT vec_id, j, round(p / greatest(pg, 1e-12), 6) AS within, round(pg * (p / greatest(pg, 1e-12)), 6) AS joint FROM lg")
def m19_joint(spark, d):
    """P(subtopic | general) and P(subtopic) of every vector."""
    rows = subtopic_probs(spark, d)
    joint = heads.joint_probs(F.col("general"), F.col("within"), hierarchy.parents())
    return rows.select("vec_id", F.posexplode(F.arrays_zip("within", joint.alias("joint"))).alias("j", "x")).select("vec_id", F.col("j").cast("long").alias("j"), F.round("x.within", 6).alias("within"), F.round("x.joint", 6).alias("joint"))


@R.register(f"""WITH {_SUBS}, best AS (SELECT vec_id, arg_max(g, (pg, -g)) AS top FROM lg GROUP BY 1), own AS (SELECT lg.*, p / greatest(pg, 1e-12) AS w FROM lg JOIN best ON lg.vec_id = best.vec_id AND g = top),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, j) AS r FROM own) SELECT vec_id, g::BIGINT AS general, string_agg(j::VARCHAR, ',' ORDER BY j) AS subs FROM r WHERE r = 1 OR w >= 0.4 GROUP BY ALL""")
def m20_decided(spark, d):
    """The general topic of every vector and its subtopics: the best, and those from 0.4 on."""
    rows = subtopic_probs(spark, d).withColumn("top", V.argmax(F.col("general")))
    chosen = heads.decide_subtopics(F.col("within"), hierarchy.parents(), F.col("top"), 0.4)
    picked = F.filter(F.transform(chosen, lambda c, j: F.when(c == 1, j)), lambda j: j.isNotNull())
    return rows.select("vec_id", F.col("top").cast("long").alias("general"), F.array_join(picked.cast("array<string>"), ",").alias("subs"))


@R.register(f"WITH {_PRED} SELECT vec_id, round(conf, 6) AS msp, round(list_max(l) + 1.5 * ln(list_sum(list_transform(l, lambda x: exp((x - list_max(l)) / 1.5)))), 6) AS energy FROM dec")
def g2_g3_confidence(spark, d):
    """Largest probability and energy of every vector."""
    return predictions(spark, d).select("vec_id", F.round(detectors.max_probability(F.col("probs")), 6).alias("msp"), F.round(detectors.energy(F.col("logits"), 1.5), 6).alias("energy"))


_CENTROIDS = """m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL), c AS (SELECT label AS g, list(m ORDER BY i) AS m FROM m GROUP BY 1),
u AS (SELECT g, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda z: z * z)))) AS m FROM c)"""


@R.register(f"WITH {_CENTROIDS} SELECT vec_id, round(max(list_inner_product(CAST(embedding AS DOUBLE[]), m)), 6) AS score FROM embeddings, u GROUP BY vec_id")
def g1_centroids(spark, d):
    """Largest cosine of every vector with a class direction."""
    rows = embeddings(spark, d)
    return detectors.centroid_scores(rows, "x", detectors.class_means(rows, "x", "label")).select("vec_id", F.round("score", 6).alias("score"))


@R.register("SELECT vec_id, round(avg(s), 6) AS score FROM (SELECT a.vec_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC) AS r FROM embeddings a, embeddings b WHERE b.label < 7) WHERE r <= 10 GROUP BY vec_id")
def g5_knn(spark, d):
    """Mean dot product of every vector with its ten nearest of the known classes."""
    rows = embeddings(spark, d)
    return detectors.knn_scores(rows, rows.where("label < 7"), "vec_id", "x").select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@R.register()
def g4_mahalanobis(spark, d):
    """Minus the least squared distance of every vector to a known class."""
    rows = embeddings(spark, d)
    means, precision = detectors.ledoit_wolf(rows.where("label < 7"), "x", "label", 64)
    return detectors.mahalanobis_scores(rows, "vec_id", "x", means, precision)


@R.register(f"WITH {_PRED} SELECT round(quantile_cont(conf, 0.05), 6) AS threshold FROM dec WHERE y < 7")
def g8_threshold(spark, d):
    """The confidence that 95 % of the known classes have."""
    rows = evaluation.with_decision(predictions(spark, d).where("y < 7"))
    return detectors.quantile_threshold(rows, "conf").select(F.round("threshold", 6).alias("threshold"))


_BINS = "(SELECT *, CASE WHEN conf > 0 THEN length(list_filter(list_transform(range(0, {n} + 1), lambda i: i / {n}.0::DOUBLE), lambda e: e < conf)) - 1 END AS bin FROM dec)"


@R.register(f"WITH {_PRED} SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (SELECT bin, count(*) AS n, avg(hit) AS a, avg(conf) AS c FROM {_BINS.format(n=15)} GROUP BY bin)")
def e1_calibration_error(spark, d):
    return evaluation.calibration_error(predictions(spark, d)).select(F.round("ece", 6).alias("ece"), "n")


@R.register(f"WITH {_PRED} SELECT bin::BIGINT AS bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg(hit), 6) AS accuracy FROM {_BINS.format(n=10)} WHERE bin IS NOT NULL GROUP BY bin")
def e2_reliability(spark, d):
    return evaluation.reliability(predictions(spark, d)).select(F.col("bin").cast("long").alias("bin"), "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


_CLASS = "cls AS (SELECT k AS label, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, support FROM (SELECT k, (SELECT count(*) FROM dec WHERE y = k) AS support, (SELECT count(*) FROM dec WHERE pred = k) AS said, (SELECT count(*) FROM dec WHERE pred = k AND y = k) AS tp FROM (SELECT unnest(range(0, 10)) AS k))), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM cls)"


@R.register(f"WITH {_PRED}, {_CLASS} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def e3_per_class(spark, d):
    return evaluation.per_class(predictions(spark, d), CLASSES).select(F.col("label").cast("long").alias("label"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@R.register(f"""WITH {_PRED}, {_CLASS} SELECT * FROM (SELECT count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(-ln(greatest(least(probs[y + 1], 1.0), 1e-12))), 6) AS log_loss, round(avg(list_sum(list_transform(range(0, 10), lambda i: (probs[i + 1] - CASE WHEN i = y THEN 1 ELSE 0 END) ** 2))), 6) AS brier FROM dec),
(SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(p * support) / sum(support), 6) AS weighted_precision, round(sum(r * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f)""")
def e3_multiclass(spark, d):
    report = evaluation.multiclass_report(predictions(spark, d), CLASSES)
    return report.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "log_loss", "brier", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, y, pred, scores) of twelve labels a vector."""
    at = lambda start, low: F.transform(F.slice("x", start, 12), lambda x: (x > low).cast("int"))
    return embeddings(spark, d).select("vec_id", at(1, 0.12).alias("y"), at(13, 0.1).alias("pred"), F.slice("x", 25, 12).alias("scores"))


_MULTI = """b AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: CASE WHEN CAST(x AS DOUBLE) > 0.12 THEN 1 ELSE 0 END) AS y, list_transform(embedding[13:24], lambda x: CASE WHEN CAST(x AS DOUBLE) > 0.1 THEN 1 ELSE 0 END) AS p, embedding[25:36] AS s FROM embeddings),
o AS (SELECT vec_id, y, p, list_sum(list_transform(range(1, 13), lambda i: y[i] * p[i])) AS h, list_sum(y) AS ny, list_sum(p) AS np, list_transform(list_sort(list_transform(range(1, 13), lambda i: {'s': -CAST(s[i] AS DOUBLE), 'i': i})), lambda x: x.i) AS rk FROM b),
lo AS (SELECT i, sum(y[i] * p[i]) AS tp, sum(y[i]) AS sp, sum(p[i]) AS sd FROM b, (SELECT unnest(range(1, 13)) AS i) GROUP BY i), lf AS (SELECT *, coalesce(2 * tp / nullif(sp + sd, 0), 0) AS f FROM lo)"""


@R.register(f"""WITH {_MULTI} SELECT * FROM (SELECT count(*) AS n, round(2 * sum(h) / sum(ny + np), 6) AS micro_f1, round(avg(coalesce(2 * h / nullif(ny + np, 0), 0)), 6) AS samples_f1, round(sum(ny + np - 2 * h) / (count(*) * 12), 6) AS hamming_loss, round(avg(CASE WHEN y = p THEN 1 ELSE 0 END), 6) AS subset_accuracy, round(avg(y[rk[1]]), 6) AS precision_at_1, round(avg((y[rk[1]] + y[rk[2]] + y[rk[3]]) / greatest(ny, 1)), 6) AS recall_at_3 FROM o),
(SELECT round(avg(f), 6) AS macro_f1, round(avg(f) FILTER (WHERE sp > 0), 6) AS macro_f1_supported, count(*) FILTER (WHERE sp > 0) AS labels_supported, round(sum(f * sp) / sum(sp), 6) AS weighted_f1 FROM lf)""")
def e4_multilabel(spark, d):
    report = evaluation.multilabel_report(labelled(spark, d), 12)
    return report.select("n", "labels_supported", *(F.round(c, 6).alias(c) for c in ("micro_f1", "samples_f1", "hamming_loss", "subset_accuracy", "precision_at_1", "recall_at_3", "macro_f1", "macro_f1_supported", "weighted_f1")))


@R.register(f"""WITH {_PRED}, s AS (SELECT round(conf, 9) AS score, y < 7 AS inside FROM dec), g AS (SELECT score, count(*) FILTER (WHERE inside) AS i, count(*) FILTER (WHERE NOT inside) AS o FROM s GROUP BY 1), c AS (SELECT *, sum(i) OVER (ORDER BY score) AS ci, sum(o) OVER (ORDER BY score) AS co FROM g),
z AS (SELECT count(*) FILTER (WHERE inside) AS n_in, count(*) FILTER (WHERE NOT inside) AS n_ood, quantile_cont(score, 0.05) FILTER (WHERE inside) AS thr FROM s)
SELECT (SELECT round(sum(i * (co - o / 2)) / any_value(n_in * n_ood), 6) FROM c, z) AS auroc, (SELECT round(sum(o * co / (co + ci)) FILTER (WHERE o > 0) / any_value(n_ood), 6) FROM c, z) AS aupr_ood, (SELECT round(avg(CASE WHEN score >= thr THEN 1 ELSE 0 END), 6) FROM s, z WHERE NOT inside) AS fpr_at_95_tpr, n_in, n_ood FROM z""")
def e5_off_topic(spark, d):
    """How well the confidence tells the classes below 7 from the others."""
    rows = evaluation.with_decision(predictions(spark, d)).select(F.round("conf", 9).alias("score"), (F.col("y") < 7).alias("inside"))
    return evaluation.off_topic_report(rows).select(*(F.round(c, 6).alias(c) for c in ("auroc", "aupr_ood", "fpr_at_95_tpr")), "n_in", "n_ood")


_STATUS = "CASE WHEN vec_id % 11 = 0 THEN 'non_english' WHEN vec_id % 13 = 0 THEN 'uninformative' WHEN conf < 0.3 THEN 'uncertain' ELSE 'ok' END"


@R.register(f"WITH {_PRED}, t AS (SELECT {_STATUS} AS status, hit FROM dec) SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN status = '{s}' THEN 1 ELSE 0 END), 6) AS {s}_rate" for s in ("ok", "uncertain", "non_english", "uninformative")) + ", round(avg(hit), 6) AS accuracy, round(avg(hit) FILTER (WHERE status = 'ok'), 6) AS answered_accuracy, round(avg(hit) FILTER (WHERE status <> 'ok'), 6) AS uncertain_accuracy FROM t")
def e8_gates(spark, d):
    """Shares of the gates' answers and accuracies behind them."""
    routed = detectors.route(F.lit(True), F.col("vec_id") % 11 != 0, F.col("vec_id") % 13 != 0, F.lit(0.0), F.col("conf"), -1.0, 0.3)
    report = evaluation.gate_summary(evaluation.with_decision(predictions(spark, d)).withColumn("status", routed))
    return report.select("n", *(F.round(c, 6).alias(c) for c in report.columns if c != "n"))


@R.register(f"WITH {_PRED} SELECT y::BIGINT AS y, count(*) AS n, round(avg(hit), 6) AS rate FROM dec GROUP BY y")
def e9_by_class(spark, d):
    rows = evaluation.with_decision(predictions(spark, d))
    return evaluation.rate_by(rows, ["y"], F.col("hit")).select(F.col("y").cast("long").alias("y"), "n", F.round("rate", 6).alias("rate"))


@R.register(f"WITH {_PRED} SELECT y::BIGINT AS y, pred, count(*) AS n, round(count(*) / (SELECT count(*) FROM dec x WHERE x.y = dec.y), 6) AS share FROM dec WHERE y <> pred GROUP BY y, pred ORDER BY n DESC, y, pred LIMIT 10")
def e10_confusions(spark, d):
    pairs = evaluation.confusion_pairs(predictions(spark, d))
    return pairs.select(F.col("y").cast("long").alias("y"), F.col("pred").cast("long").alias("pred"), "n", F.round("share", 6).alias("share"))


@R.register(f"WITH {_PRED} SELECT vec_id, y::BIGINT AS y, pred, round(conf, 6) AS conf FROM dec WHERE y <> pred ORDER BY dec.conf DESC, vec_id LIMIT 20")
def e11_mistakes(spark, d):
    rows = evaluation.confident_mistakes(predictions(spark, d), "vec_id")
    return rows.select("vec_id", F.col("y").cast("long").alias("y"), F.col("pred").cast("long").alias("pred"), F.round("conf", 6).alias("conf"))


@R.register(f"WITH {_PRED} SELECT CASE WHEN GROUPING(y) = 1 THEN 'all' ELSE y::VARCHAR END AS y, count(*) AS n, round(avg(hit), 6) AS rate FROM dec GROUP BY GROUPING SETS ((y), ())")
def e13_with_total(spark, d):
    rows = evaluation.with_decision(predictions(spark, d)).withColumn("y", F.col("y").cast("string"))
    return evaluation.rate_with_total(rows, "y", F.col("hit")).select("y", "n", F.round("rate", 6).alias("rate"))


_GRID = [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]


@R.register(f"WITH {_PRED} SELECT t AS threshold, round(avg(CASE WHEN conf >= t THEN 1 ELSE 0 END), 6) AS coverage, round(avg(hit) FILTER (WHERE conf >= t), 6) AS accuracy FROM dec, (SELECT unnest({_GRID})::DOUBLE AS t) GROUP BY t")
def x4_coverage(spark, d):
    """Coverage and accuracy at each threshold."""
    return evaluation.coverage_curve(predictions(spark, d), _GRID).select("threshold", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


@R.register("SELECT round(min(c), 6) AS min_cosine, round(avg(c), 6) AS mean_cosine, round(max(m), 6) AS max_difference FROM (SELECT list_cosine_similarity(a, b) AS c, list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))) AS m FROM (SELECT CAST(embedding AS DOUBLE[]) AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 2)) AS b FROM embeddings))")
def e25_drift(spark, d):
    """What rounding the vectors to two decimals changes."""
    rows = embeddings(spark, d).withColumn("short", F.transform("x", lambda x: F.round(x, 2)))
    return evaluation.drift(rows, "x", "short").select(*(F.round(c, 6).alias(c) for c in ("min_cosine", "mean_cosine", "max_difference")))


@R.register()
def m11_softmax(spark, d):
    """A softmax head fitted on the even vectors and its report on the odd ones."""
    rows = embeddings(spark, d)
    head = heads.fit_softmax(rows.where("vec_id % 2 = 0"), "x", "label", 1.0, CLASSES, 50)
    scored = rows.where("vec_id % 2 = 1").select(F.col("label").alias("y"), V.softmax(head.logits(F.col("x"))).alias("probs"))
    return evaluation.multiclass_report(scored, CLASSES)


@R.register()
def m12_temperature(spark, d):
    """The temperature of the least loss of the predictions."""
    return spark.createDataFrame([(heads.fit_temperature(predictions(spark, d), heads.true_probability),)], "temperature double")


@R.register()
def m22_alternatives(spark, d):
    """Accuracies of other classifiers, fitted on the even vectors, on the odd ones."""
    rows = embeddings(spark, d).withColumn("positive", F.transform("x", lambda x: x + 1))
    odd = rows.where("vec_id % 2 = 1").select(F.col("label").alias("y"), heads.array_to_vector("positive").alias("features"))
    out = []
    margins = heads.fit_alternative("svm", rows.where("vec_id % 2 = 0"), "x", "label")
    out.append(("svm", rows.where("vec_id % 2 = 1").agg(F.avg((margins.predict(F.col("x")) == F.col("label")).cast("double"))).first()[0]))
    for kind in ("naive_bayes", "complement_naive_bayes"):
        model = heads.fit_alternative(kind, rows.where("vec_id % 2 = 0"), "positive", "label")
        out.append((kind, model.transform(odd).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]))
    common = heads.fit_alternative("majority", rows.where("vec_id % 2 = 0"), "positive", "label")
    out.append(("majority", odd.agg(F.avg((F.col("y") == common).cast("double"))).first()[0]))
    return spark.createDataFrame(out, "head string, accuracy double")


@R.register()
def m26_topic_model(spark, d):
    """A topic model of `passage_vectors`' labelled passages, fitted on train, its report on test."""
    passages = corpora.delivered(spark, d).where("g is not null").select("passage_id", F.col("g").alias("general"), hierarchy.subtopic_list("subtopics").alias("subtopics"), "s")
    known = hierarchy.is_consistent(F.col("general"), F.col("subtopics")) & (F.size("subtopics") > 0)
    rows = table(spark, d, "passage_vectors").where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).select("passage_id", F.col("embedding").cast("array<double>").alias("features")).join(passages.where(known), "passage_id")
    rows = cut(rows)
    model = topic_model.fit_topic_model(rows.where("s = 'train'"), rows.where("s = 'val'"), iterations=30)
    scored = model.predict(rows.where("s = 'test'").drop("subtopics").withColumnRenamed("general", "truth"))
    return evaluation.multiclass_report(scored.select(hierarchy.encode_general(F.col("truth")).alias("y"), F.col("general_probs").alias("probs")), len(hierarchy.GENERALS))


@R.register()
def m28_fingerprint(spark, d):
    """A digest of the catalogue that does not depend on the order of rows."""
    return files.fingerprint(table(spark, d, "articles"))


_RECALL = " UNION ALL ".join(f"SELECT {k}::DOUBLE AS keep_out, quantile_cont(conf, {k}) AS thr FROM t WHERE inside" for k in (0.01, 0.05, 0.1))


@R.register(f"WITH {_PRED}, t AS (SELECT y < 7 AS inside, conf FROM dec), q AS ({_RECALL}) SELECT keep_out, round(any_value(thr), 6) AS threshold, round(avg(CASE WHEN conf < thr THEN 1 ELSE 0 END) FILTER (WHERE NOT inside), 6) AS recall FROM t, q GROUP BY keep_out")
def x5_gate_recalls(spark, d):
    """How many of the other classes each quantile of the known ones rejects."""
    rows = evaluation.with_decision(predictions(spark, d)).select((F.col("y") < 7).alias("inside"), "conf")
    ks = [0.01, 0.05, 0.1]
    limits = evaluation.quantile(rows.where("inside"), "conf", ks).select(F.col("share").alias("keep_out"), F.col("value").alias("threshold"))
    other = rows.where("not inside").crossJoin(F.broadcast(limits))
    return other.groupBy("keep_out", "threshold").agg(F.round(F.avg((F.col("conf") < F.col("threshold")).cast("double")), 6).alias("recall")).select("keep_out", F.round("threshold", 6).alias("threshold"), "recall")


_POSITIVE = "coalesce(nullif(list_position(y, 1), 0), 1) - 1"


@R.register(f"WITH {_MULTI} SELECT ({_POSITIVE})::BIGINT AS label, count(*) AS n FROM b GROUP BY 1")
def m16_first_positive(spark, d):
    """The classes that a flat head over labels learns."""
    return labelled(spark, d).groupBy(heads.first_positive(F.col("y")).cast("long").alias("label")).agg(F.count("*").alias("n"))


_GROUPS = [j % 3 for j in range(12)]


@R.register(f"WITH {_MULTI}, x AS (SELECT e.label % 3 AS g, b.y FROM b JOIN embeddings e USING (vec_id)), k AS (SELECT unnest(range(0, 12)) AS j, unnest({_GROUPS}) AS g) SELECT k.g::BIGINT AS general, k.j AS label, count(*) AS n, CAST(sum(y[k.j + 1]) AS BIGINT) AS positives, sum(y[k.j + 1]) > 0 AND sum(y[k.j + 1]) < count(*) AS fitted FROM x JOIN k USING (g) GROUP BY ALL")
def m18_grouped_heads(spark, d):
    """The rows that each label's head learns from, within its general topic."""
    rows = labelled(spark, d).join(table(spark, d, "embeddings").select("vec_id", (F.col("label") % 3).cast("int").alias("g")), "vec_id")
    return heads.head_plan(rows, "g", "y", _GROUPS).select(F.col("general").cast("long").alias("general"), F.col("label").cast("long").alias("label"), "n", "positives", "fitted")


_DESCRIBED = [(g, f"{g.title()}: a text about {g.replace('_', ' ')}, including " + ", ".join(r[6] for r in hierarchy.taxonomy_rows() if r[1] == g) + ".") for g in hierarchy.GENERALS]
_SLOT = "strpos('0123456789abcdef', md5(w)[30:30]) * 256 - 256 + strpos('0123456789abcdef', md5(w)[31:31]) * 16 - 16 + strpos('0123456789abcdef', md5(w)[32:32]) - 1"
_HASHED = f"SELECT id, slot, count(*) / sqrt(sum(count(*) * count(*)) OVER (PARTITION BY id)) AS x FROM (SELECT id, {_SLOT} AS slot FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {{0}})) GROUP BY id, slot"


@R.register(f"""WITH t AS ({_HASHED.format("(SELECT item_id AS id, text FROM heldout_items)")}), l AS ({_HASHED.format("(VALUES " + ", ".join(f"({n}, '{text}')" for n, (_, text) in enumerate(_DESCRIBED)) + ") AS v(id, text)")}),
i AS (SELECT item_id AS id, n FROM heldout_items, (SELECT unnest(range(0, 8)) AS n)), c AS (SELECT i.id, i.n, coalesce(sum(t.x * l.x), 0) AS c FROM i LEFT JOIN t ON t.id = i.id LEFT JOIN l ON l.id = i.n AND l.slot = t.slot GROUP BY ALL),
e AS (SELECT *, exp((c - max(c) OVER (PARTITION BY id)) / 0.05) AS e FROM c) SELECT id AS item_id, n AS label, round(e / sum(e) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS p FROM e""")
def m10_label_similarity(spark, d):
    """Zero-shot probabilities of the general topics of held-out texts, by the cosine with a sentence that describes each."""
    labels = profile.hashed_vectors(spark.createDataFrame(list(enumerate(t for _, t in _DESCRIBED)), "n long, text string"), "n", "text").select("n", "slot", F.col("x").alias("y"))
    items = table(spark, d, "heldout_items").select("item_id", "text")
    dots = profile.hashed_vectors(items, "item_id", "text").join(F.broadcast(labels), "slot").groupBy("item_id", "n").agg(F.sum(F.col("x") * F.col("y")).alias("c"))  # eight descriptions
    mapped = dots.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "c"))).alias("m"))
    cosines = F.transform(F.sequence(F.lit(0), F.lit(len(_DESCRIBED) - 1)), lambda n: F.coalesce(F.try_element_at("m", n.cast("long")), F.lit(0.0)))
    probs = items.select("item_id").join(mapped, "item_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<bigint,double>"))).select("item_id", heads.similarity_probs(cosines).alias("p"))
    return probs.select("item_id", F.posexplode("p").alias("label", "p")).select("item_id", F.col("label").cast("long").alias("label"), F.round("p", 6).alias("p"))


_NAMES = "CASE WHEN y < 5 THEN 'known' WHEN y < 7 THEN 'near' ELSE 'far' END"
_PAIRS = [("known", "near"), ("known", "far")]

def _pair_sql(one: str, two: str) -> str:
    return f"""SELECT * FROM (WITH s AS (SELECT round(conf, 9) AS score, name = '{one}' AS inside FROM nm WHERE name IN ('{one}', '{two}')), g AS (SELECT score, count(*) FILTER (WHERE inside) AS i, count(*) FILTER (WHERE NOT inside) AS o FROM s GROUP BY 1), c AS (SELECT *, sum(i) OVER (ORDER BY score) AS ci, sum(o) OVER (ORDER BY score) AS co FROM g),
z AS (SELECT count(*) FILTER (WHERE inside) AS n_in, count(*) FILTER (WHERE NOT inside) AS n_ood, quantile_cont(score, 0.05) FILTER (WHERE inside) AS thr FROM s)
SELECT '{one}' AS one, '{two}' AS two, (SELECT round(sum(i * (co - o / 2)) / any_value(n_in * n_ood), 6) FROM c, z) AS auroc, (SELECT round(sum(o * co / (co + ci)) FILTER (WHERE o > 0) / any_value(n_ood), 6) FROM c, z) AS aupr_ood, (SELECT round(avg(CASE WHEN score >= thr THEN 1 ELSE 0 END), 6) FROM s, z WHERE NOT inside) AS fpr_at_95_tpr, n_in, n_ood FROM z)"""


@R.register(f"WITH {_PRED}, nm AS (SELECT conf, {_NAMES} AS name FROM dec) " + " UNION ALL ".join(_pair_sql(*p) for p in _PAIRS))
def e6_pairs(spark, d):
    """How well the confidence tells one set of classes from each of two others."""
    rows = evaluation.with_decision(predictions(spark, d)).select(F.round("conf", 9).alias("score"), F.when(F.col("y") < 5, "known").when(F.col("y") < 7, "near").otherwise("far").alias("name"))
    return evaluation.off_topic_pairs(rows, _PAIRS).select("one", "two", *(F.round(c, 6).alias(c) for c in ("auroc", "aupr_ood", "fpr_at_95_tpr")), "n_in", "n_ood")


@R.register(R.sql["e4_multilabel"].replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT vec_id FROM dec WHERE hit = 1))", 1).replace("WITH ", f"WITH {_PRED}, ", 1))
def e7_given_correct(spark, d):
    """The multilabel report of the vectors whose class is predicted right."""
    right = evaluation.with_decision(predictions(spark, d)).where("hit = 1").select("vec_id")
    report = evaluation.multilabel_report(labelled(spark, d).join(right, "vec_id", "left_semi"), 12)
    return report.select("n", "labels_supported", *(F.round(c, 6).alias(c) for c in ("micro_f1", "samples_f1", "hamming_loss", "subset_accuracy", "precision_at_1", "recall_at_3", "macro_f1", "macro_f1_supported", "weighted_f1")))


_METRICS = ("accuracy", "log_loss", "brier", "ok_rate", "uncertain_rate", "answered_accuracy")
_SECTION = f"(SELECT section, count(*)::DOUBLE AS n, avg(hit) AS accuracy, avg(-ln(greatest(least(probs[y + 1], 1.0), 1e-12))) AS log_loss, avg(list_sum(list_transform(range(0, 10), lambda i: (probs[i + 1] - CASE WHEN i = y THEN 1 ELSE 0 END) ** 2))) AS brier, avg(CASE WHEN conf >= 0.3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS ok_rate, avg(CASE WHEN conf < 0.3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS uncertain_rate, avg(hit) FILTER (WHERE conf >= 0.3) AS answered_accuracy FROM (SELECT *, unnest(CASE WHEN vec_id % 2 = 0 THEN ['dev', 'all'] ELSE ['locked', 'all'] END) AS section FROM dec) GROUP BY 1)"


@R.register(f"WITH {_PRED}, r AS {_SECTION} " + " UNION ALL ".join(f"SELECT section, '{m}' AS metric, round({m}, 6) AS value FROM r" for m in ("n", *_METRICS)))
def e15_sections(spark, d):
    """Reports of the stages' sections, one value a row."""
    rows = predictions(spark, d).withColumn("status", F.when(F.array_max("probs") < 0.3, "uncertain").otherwise("ok"))
    sections = {"all": F.lit(True), "dev": F.col("vec_id") % 2 == 0, "locked": F.col("vec_id") % 2 == 1}
    found = evaluation.section_reports(rows, sections, CLASSES).where(F.col("metric").isin("n", *_METRICS))
    return found.select("section", "metric", F.round("value", 6).alias("value"))


_SWEEP = [0.1, 0.2, 0.3, 0.4, 0.5]


def swept(spark: SparkSession, d: str) -> DataFrame:
    """(within, top, truth): a vector's true subtopics are two that its label names."""
    rows = subtopic_probs(spark, d).withColumn("top", V.argmax(F.col("general")))
    truth = F.transform(F.sequence(F.lit(0), F.lit(27)), lambda j: ((j == F.col("label") * 2) | (j == F.col("label") * 2 + 1)).cast("int"))
    return rows.join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").select("within", "top", truth.alias("truth"))


_SWEPT = f"""{_SUBS}, best AS (SELECT vec_id, arg_max(g, (pg, -g)) AS top FROM lg GROUP BY 1), own AS (SELECT lg.vec_id, lg.label, j, CASE WHEN g = top THEN p / greatest(pg, 1e-12) ELSE -1 END AS w FROM lg JOIN best USING (vec_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, j) AS r FROM own), dc AS (SELECT vec_id, j, t, CASE WHEN r = 1 OR w >= t THEN 1 ELSE 0 END AS c, CASE WHEN j IN (label * 2, label * 2 + 1) THEN 1 ELSE 0 END AS y FROM rk, (SELECT unnest({_SWEEP})::DOUBLE AS t)),
lb AS (SELECT t, j, sum(c * y) AS h, sum(c + y) AS s FROM dc GROUP BY ALL), sm AS (SELECT t, avg(f) AS samples_f1 FROM (SELECT t, vec_id, coalesce(2 * sum(c * y) / nullif(sum(c + y), 0), 0) AS f FROM dc GROUP BY ALL) GROUP BY t),
sw AS (SELECT t AS threshold, 2 * sum(h) / sum(s) AS micro_f1, avg(coalesce(2 * h / nullif(s, 0), 0)) AS macro_f1, any_value(samples_f1) AS samples_f1 FROM lb JOIN sm USING (t) GROUP BY t)"""


@R.register(f"WITH {_SWEPT} SELECT threshold, round(micro_f1, 6) AS micro_f1, round(macro_f1, 6) AS macro_f1, round(samples_f1, 6) AS samples_f1, threshold = (SELECT arg_max(threshold, (round(macro_f1, 6), -threshold)) FROM sw) AS best FROM sw")
def x2_sweep(spark, d):
    """F1 of the subtopics at each threshold, and the threshold of the best macro F1."""
    rows = swept(spark, d)
    found = evaluation.threshold_sweep(rows, _SWEEP, 28, lambda t: heads.decide_subtopics(F.col("within"), hierarchy.parents(), F.col("top"), t))
    rounded = found.select("threshold", *(F.round(c, 6).alias(c) for c in ("micro_f1", "macro_f1", "samples_f1")))
    best = evaluation.best_by(rounded, [], "macro_f1", ["threshold"]).select(F.col("threshold").alias("best"))
    return rounded.crossJoin(F.broadcast(best)).withColumn("best", F.col("threshold") == F.col("best"))


def _at(offset: int, sharpness: float) -> str:
    return f"SELECT {offset} AS feature, {sharpness}::DOUBLE AS head, avg(CASE WHEN list_position(l, list_max(l)) - 1 = y THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy, avg(ln(list_sum(list_transform(l, lambda x: exp({sharpness} * (x - l[y + 1])))))) AS log_loss FROM (SELECT label AS y, list_transform(embedding[{offset}:{offset + 9}], lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)"


_CHOICES = [(offset, sharp) for offset in (1, 11, 21) for sharp in (1.0, 5.0)]


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    """(feature, head, accuracy, log_loss) of a grid of ten coordinates each and of how sharp they are taken; one aggregate."""
    aggs = []
    for k, (offset, sharp) in enumerate(_CHOICES):
        logits = F.slice("x", offset, 10)
        probs = V.softmax(logits, 1.0 / sharp)
        aggs += [F.avg((V.argmax(logits) == F.col("label")).cast("double")).alias(f"a{k}"), F.avg(-F.log(probs[F.col("label")])).alias(f"l{k}")]
    points = F.array(*(F.struct(F.lit(o).alias("feature"), F.lit(s).alias("head"), F.col(f"a{k}").alias("accuracy"), F.col(f"l{k}").alias("log_loss")) for k, (o, s) in enumerate(_CHOICES)))
    return embeddings(spark, d).agg(*aggs).select(F.explode(points).alias("p")).select("p.*")


@R.register("WITH g AS (" + " UNION ALL ".join(_at(*c) for c in _CHOICES) + ") SELECT head, feature, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY round(accuracy, 9) DESC, feature) AS r FROM g) WHERE r = 1")
def x1_best(spark, d):
    """The best features for each head of a grid."""
    best = evaluation.best_by(benchmark(spark, d).withColumn("accuracy", F.round("accuracy", 9)), ["head"], "accuracy", ["feature"])
    return best.select("head", "feature", F.round("accuracy", 6).alias("accuracy"))


@R.register("WITH g AS (" + " UNION ALL ".join(_at(*c) for c in _CHOICES) + "), k AS (SELECT *, round(accuracy, 9) >= (SELECT max(round(accuracy, 9)) FROM g) - 0.02 AS near FROM g) SELECT feature, head, round(accuracy, 6) AS accuracy, round(log_loss, 6) AS log_loss, near AND row_number() OVER (ORDER BY near DESC, CASE WHEN near THEN round(-log_loss, 9) END DESC NULLS LAST, feature, head) = 1 AS chosen FROM k")
def x6_choice(spark, d):
    """The grid with its choice: of those within 0.02 of the best accuracy the one of the least loss."""
    rows = benchmark(spark, d).withColumn("accuracy", F.round("accuracy", 9)).withColumn("gain", F.round(-F.col("log_loss"), 9))
    found = evaluation.chosen(rows, "accuracy", 0.02, "gain", ["feature", "head"])
    return found.select("feature", "head", F.round("accuracy", 6).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"), "chosen")


_STAGES = (1.0, 1.5)
_WARM = "l AS (SELECT vec_id, label AS y, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 10 / {0}) AS l FROM embeddings)"


def _stage_sql(t: float) -> str:
    pred = _PRED.replace(_PRED[: _PRED.index("ex AS")], _WARM.format(t) + ",\n", 1)
    bins = _BINS.format(n=15)
    return f"SELECT * FROM (WITH {pred} SELECT {t}::DOUBLE AS temperature, (SELECT round(sum(n * abs(a - c)) / sum(n), 6) FROM (SELECT bin, count(*) AS n, avg(hit) AS a, avg(conf) AS c FROM {bins} GROUP BY bin)) AS ece, round(avg(-ln(greatest(probs[y + 1], 1e-12))), 6) AS log_loss, round(avg(hit), 6) AS accuracy FROM dec)"


@R.register(" UNION ALL ".join(_stage_sql(t) for t in _STAGES))
def x3_calibration(spark, d):
    """Calibration error and loss before and after a temperature."""
    out = None
    for t in _STAGES:
        rows = predictions(spark, d).select("vec_id", "y", V.softmax(F.col("logits"), t).alias("probs"))
        one = evaluation.multiclass_report(rows, CLASSES).select(F.lit(t).alias("temperature"), *(F.round(c, 6).alias(c) for c in ("ece", "log_loss", "accuracy")))
        out = one if out is None else out.unionByName(one)
    return out


def _detector_sql(name: str, score: str) -> str:
    return f"SELECT * FROM (WITH s AS (SELECT round({score}, 9) AS score, y < 7 AS inside FROM dec), g AS (SELECT score, count(*) FILTER (WHERE inside) AS i, count(*) FILTER (WHERE NOT inside) AS o FROM s GROUP BY 1), c AS (SELECT *, sum(o) OVER (ORDER BY score) AS co FROM g), z AS (SELECT count(*) FILTER (WHERE inside) AS n_in, count(*) FILTER (WHERE NOT inside) AS n_ood, quantile_cont(score, 0.05) FILTER (WHERE inside) AS thr FROM s) SELECT '{name}' AS detector, (SELECT round(sum(i * (co - o / 2)) / any_value(n_in * n_ood), 6) FROM c, z) AS auroc, (SELECT round(avg(CASE WHEN score < thr THEN 1 ELSE 0 END), 6) FROM s, z WHERE NOT inside) AS recall)"


_ENERGY = "list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l)))))"


@R.register(f"WITH {_PRED}, r AS ({_detector_sql('msp', 'conf')} UNION ALL {_detector_sql('energy', _ENERGY)}), k AS (SELECT *, auroc >= (SELECT max(auroc) FROM r) - 0.01 AS near FROM r) SELECT detector, auroc, recall, near AND row_number() OVER (ORDER BY near DESC, CASE WHEN near THEN recall END DESC NULLS LAST, detector) = 1 AS chosen FROM k")
def x7_detectors(spark, d):
    """Two detectors of unknown classes, and the choice among those of about the best AUROC: that of the best recall."""
    rows, out = evaluation.with_decision(predictions(spark, d)), None
    for name, score in (("msp", F.col("conf")), ("energy", detectors.energy(F.col("logits"), 1.0))):
        one = evaluation.off_topic_report(rows.select(F.round(score, 9).alias("score"), (F.col("y") < 7).alias("inside")))
        one = one.select(F.lit(name).alias("detector"), F.round("auroc", 6).alias("auroc"), F.round(1 - F.col("fpr_at_95_tpr"), 6).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return evaluation.chosen(out, "auroc", 0.01, "recall", ["detector"])
