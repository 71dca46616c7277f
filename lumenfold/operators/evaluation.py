"""Metrics of predictions as aggregates.

Predictions are rows (y int, probs array<double>), y being the true class's place, or for
several labels (y array<int>, pred array<int>, scores array<double>). Every report is one
aggregate over the rows (partial before the shuffle) and arithmetic on its few results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.vectors import argmax, cosine, total
from lumenfold.plans.lineage import cut


def with_decision(rows: DataFrame) -> DataFrame:
    """Rows with pred, conf and hit; the first maximum decides."""
    return rows.withColumns({"pred": argmax(F.col("probs")), "conf": F.array_max("probs")}).withColumn("hit", (F.col("pred") == F.col("y")).cast("double"))


def bin_of(conf: Column, bins: int) -> Column:
    """Number of the bin (i/bins, (i+1)/bins] that holds `conf`; null for 0 and above 1."""
    edges = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    low = F.size(F.filter(edges, lambda e: e < conf)) - 1
    return F.when((conf > 0) & (conf <= 1), low)


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of the bins that are not empty."""
    return with_decision(rows).withColumn("bin", bin_of(F.col("conf"), bins)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("conf").alias("confidence"), F.avg("hit").alias("accuracy"))


def calibration_error(rows: DataFrame, bins: int = 15) -> DataFrame:
    """(ece, n): bin shares times |accuracy - confidence|. Rows of confidence 0 are in n only."""
    per = reliability(rows, bins).agg(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("s"))
    return per.crossJoin(rows.agg(F.count("*").alias("n"))).select((F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("ece"), "n")


def confusion(rows: DataFrame) -> DataFrame:
    """(y, pred, n) of the pairs that occur."""
    return with_decision(rows).groupBy("y", "pred").agg(F.count("*").alias("n"))


def per_class(rows: DataFrame, classes: int) -> DataFrame:
    """(label, precision, recall, f1, support) for every class, 0 where undefined."""
    pairs = confusion(rows)
    labels = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    true = pairs.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n"))).alias("tp"))
    said = pairs.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    all_ = labels.join(true, "label", "left").join(said, "label", "left").na.fill(0)
    p, r = (F.coalesce(F.try_divide("tp", c), F.lit(0.0)) for c in ("said", "support"))
    return all_.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def multiclass_report(rows: DataFrame, classes: int) -> DataFrame:
    """One row: n, accuracy, macro and weighted precision, recall and F1, log loss, Brier score, ECE."""
    decided = with_decision(rows)
    true = F.col("probs")[F.col("y")]
    brier = total(F.transform("probs", lambda p, i: (p - (i == F.col("y")).cast("double")) * (p - (i == F.col("y")).cast("double"))))
    overall = decided.agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg(-F.log(F.greatest(F.least(true, F.lit(1.0)), F.lit(1e-12)))).alias("log_loss"), F.avg(brier).alias("brier"))
    names = ("precision", "recall", "f1")
    each = per_class(rows, classes).agg(*(F.avg(m).alias(f"macro_{m}") for m in names), *((F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in names))
    return overall.crossJoin(each).crossJoin(calibration_error(rows).select("ece"))


def multilabel_report(rows: DataFrame, labels: int) -> DataFrame:
    """One row: micro, macro, supported, weighted and samples F1, Hamming loss, subset accuracy, P@1, R@3.

    Scores rank by value, then by place.
    """
    y, pred = F.col("y"), F.col("pred")
    hits = total(F.zip_with(y, pred, lambda a, b: (a * b).cast("double")))
    ny, npred = total(F.transform(y, lambda x: x.cast("double"))), total(F.transform(pred, lambda x: x.cast("double")))
    order = F.transform(F.array_sort(F.transform("scores", lambda s, i: F.struct((-s).alias("s"), i.alias("i")))), lambda x: x["i"])
    top3 = total(F.transform(F.slice(order, 1, 3), lambda i: y[i].cast("double")))
    per_row = rows.select("y", "pred", hits.alias("h"), ny.alias("ny"), npred.alias("np"), y[order[0]].cast("double").alias("p1"), (top3 / F.greatest(ny, F.lit(1.0))).alias("r3"))
    overall = per_row.agg(
        F.count("*").alias("n"),
        (2 * F.sum("h") / F.sum(F.col("ny") + F.col("np"))).alias("micro_f1"),
        F.avg(F.coalesce(F.try_divide(2 * F.col("h"), F.col("ny") + F.col("np")), F.lit(0.0))).alias("samples_f1"),
        (F.sum(F.col("ny") + F.col("np") - 2 * F.col("h")) / (F.count("*") * labels)).alias("hamming_loss"),
        F.avg((F.col("y") == F.col("pred")).cast("double")).alias("subset_accuracy"),
        F.avg("p1").alias("precision_at_1"),
        F.avg("r3").alias("recall_at_3"),
    )
    long = rows.select(F.posexplode(F.arrays_zip("y", "pred"))).groupBy("pos").agg(F.sum(F.col("col.y") * F.col("col.pred")).alias("tp"), F.sum("col.y").alias("support"), F.sum("col.pred").alias("said"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("said")), F.lit(0.0))
    each = long.agg(F.avg(f1).alias("macro_f1"), F.coalesce(F.avg(F.when(F.col("support") > 0, f1)), F.lit(0.0)).alias("macro_f1_supported"), F.count(F.when(F.col("support") > 0, 1)).alias("labels_supported"), F.coalesce(F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"))
    return overall.crossJoin(each)


def off_topic_report(rows: DataFrame) -> DataFrame:
    """One row from (score, inside boolean): AUROC, average precision of the outside, FPR at 95 % TPR, sizes.

    Scores are high inside. The areas come from the counts at each distinct score; running
    totals go over those, in ranges of scores, never over a single sorted partition of rows.
    """
    at = rows.groupBy("score").agg(F.sum(F.col("inside").cast("long")).alias("i"), F.sum((~F.col("inside")).cast("long")).alias("o"))
    pieces = cut(at.repartitionByRange("score").withColumn("piece", F.spark_partition_id()))  # the bounds are sampled: once
    before = pieces.groupBy("piece").agg(F.sum("i").alias("pi"), F.sum("o").alias("po"))
    up = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = before.select("piece", F.coalesce(F.sum("pi").over(up), F.lit(0)).alias("bi"), F.coalesce(F.sum("po").over(up), F.lit(0)).alias("bo"))
    inner = Window.partitionBy("piece").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = pieces.withColumns({"ci": F.sum("i").over(inner), "co": F.sum("o").over(inner)}).join(F.broadcast(offsets), "piece").select("i", "o", (F.col("ci") + F.col("bi")).alias("ci"), (F.col("co") + F.col("bo")).alias("co"))
    sizes = rows.agg(F.sum(F.col("inside").cast("long")).alias("n_in"), F.sum((~F.col("inside")).cast("long")).alias("n_ood")).crossJoin(quantile(rows.where("inside"), "score", [0.05]).select(F.col("value").alias("thr")))
    areas = running.agg(F.sum(F.col("i") * (F.col("co") - F.col("o") / 2)).alias("wins"), F.sum(F.when(F.col("o") > 0, F.col("o") * F.col("co") / (F.col("co") + F.col("ci")))).alias("ap"))
    high = rows.crossJoin(F.broadcast(sizes.select("thr"))).agg(F.avg(F.when(~F.col("inside"), (F.col("score") >= F.col("thr")).cast("double"))).alias("fpr_at_95_tpr"))
    return areas.crossJoin(sizes).crossJoin(high).select((F.col("wins") / (F.col("n_in") * F.col("n_ood"))).alias("auroc"), (F.col("ap") / F.col("n_ood")).alias("aupr_ood"), "fpr_at_95_tpr", "n_in", "n_ood")


def rate_by(rows: DataFrame, groups: list[str], hit: Column) -> DataFrame:
    """(groups, n, rate)."""
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("rate"))


def rate_with_total(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """(group, n, rate) with one more row `all`, by grouping sets: one pass."""
    named = rows.select(F.col(group).alias("g"), hit.cast("double").alias("h"))
    return named.groupingSets([["g"], []], "g").agg(F.grouping_id().alias("id"), F.count("*").alias("n"), F.avg("h").alias("rate")).select(F.when(F.col("id") == 1, "all").otherwise(F.col("g")).alias(group), "n", "rate")


def confusion_pairs(rows: DataFrame, top: int = 10) -> DataFrame:
    """(y, pred, n, share): the most frequent mistakes and their share of the true class; ties by y, then pred."""
    pairs = confusion(rows)
    sizes = pairs.groupBy("y").agg(F.sum("n").alias("all"))
    wrong = pairs.where("y <> pred").join(sizes, "y").select("y", "pred", "n", (F.col("n") / F.col("all")).alias("share"))
    return wrong.orderBy(F.desc("n"), "y", "pred").limit(top)


def confident_mistakes(rows: DataFrame, identity: str, top: int = 20) -> DataFrame:
    """The `top` mistakes of the highest confidence, ties by identity."""
    return with_decision(rows).where("y <> pred").select(identity, "y", "pred", "conf").orderBy(F.desc("conf"), identity).limit(top)


def coverage_curve(rows: DataFrame, grid: list[float]) -> DataFrame:
    """(threshold, coverage, accuracy): at each threshold the share answered and the accuracy of the answers. One aggregate."""
    decided = with_decision(rows)
    aggs = [F.count("*").alias("n")]
    for k, t in enumerate(grid):
        kept = F.col("conf") >= t
        aggs += [F.sum(kept.cast("long")).alias(f"c{k}"), F.avg(F.when(kept, F.col("hit"))).alias(f"a{k}")]
    one = decided.agg(*aggs)
    points = F.array(*(F.struct(F.lit(t).alias("threshold"), (F.col(f"c{k}") / F.col("n")).alias("coverage"), F.col(f"a{k}").alias("accuracy")) for k, t in enumerate(grid)))
    return one.select(F.explode(points).alias("p")).select("p.*")


def largest_covering(curve: DataFrame, floor: float = 0.9) -> DataFrame:
    """The largest threshold with at least the coverage, else the smallest."""
    return curve.agg(F.coalesce(F.max(F.when(F.col("coverage") >= floor, F.col("threshold"))), F.min("threshold")).alias("threshold"))


def gate_summary(rows: DataFrame) -> DataFrame:
    """From (status, hit): share of each status, accuracy of all, of the answered and of the uncertain (null if none)."""
    uncertain = F.col("status") != "ok"
    return rows.agg(F.count("*").alias("n"), *(F.avg((F.col("status") == s).cast("double")).alias(f"{s}_rate") for s in ("ok", "uncertain", "non_english", "uninformative")), F.avg("hit").alias("accuracy"), F.avg(F.when(~uncertain, F.col("hit"))).alias("answered_accuracy"), F.avg(F.when(uncertain, F.col("hit"))).alias("uncertain_accuracy"))


def drift(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """(min_cosine, mean_cosine, max_difference) of two versions of vectors."""
    gap = F.array_max(F.zip_with(F.col(one).cast("array<double>"), F.col(two).cast("array<double>"), lambda x, y: F.abs(x - y)))
    c = cosine(F.col(one), F.col(two))
    return pairs.agg(F.min(c).alias("min_cosine"), F.avg(c).alias("mean_cosine"), F.max(gap).alias("max_difference"))


def off_topic_pairs(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """`off_topic_report` of (inside set, outside set) pairs, from (name, score): with columns one, two."""
    out = None
    for one, two in pairs:
        own = rows.where(F.col("name").isin(one, two)).select("score", (F.col("name") == one).alias("inside"))
        report = off_topic_report(own).select(F.lit(one).alias("one"), F.lit(two).alias("two"), "*")
        out = report if out is None else out.unionByName(report)
    return out


def section_reports(rows: DataFrame, sections: dict[str, Column], classes: int) -> DataFrame:
    """(section, metric, value) of `multiclass_report` and, with a column status, of `gate_summary`, for each named filter."""
    out = None
    for name, condition in sections.items():
        own = rows.where(condition)
        reports = [multiclass_report(own, classes)]
        if "status" in rows.columns:
            reports.append(gate_summary(with_decision(own)).drop("n", "accuracy"))
        for report in reports:
            entries = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in report.columns))).alias("x")
            long = report.select(F.lit(name).alias("section"), entries).select("section", "x.*")
            out = long if out is None else out.unionByName(long)
    return out


def gate_rates(rows: DataFrame, bucket: str) -> DataFrame:
    """(bucket and `all`: english_accepted, non_english_rejected, balanced_accuracy, n_english, n_non_english) from (english, accepted).

    One pass by grouping sets; rates are null where there are no such rows.
    """
    english, accepted = F.col("english"), F.col("accepted").cast("double")
    grouped = rows.withColumn("_b", F.col(bucket)).groupingSets([["_b"], []], "_b").agg(
        F.grouping_id().alias("_id"),
        F.avg(F.when(english, accepted)).alias("english_accepted"),
        F.avg(F.when(~english, 1 - accepted)).alias("non_english_rejected"),
        F.count(F.when(english, 1)).alias("n_english"),
        F.count(F.when(~english, 1)).alias("n_non_english"),
    )
    both = (F.col("english_accepted") + F.col("non_english_rejected")) / 2
    return grouped.select(F.when(F.col("_id") == 1, "all").otherwise(F.col("_b")).alias(bucket), "english_accepted", "non_english_rejected", both.alias("balanced_accuracy"), "n_english", "n_non_english")


def accepted_cases(found: DataFrame, cases: DataFrame, key: list[str], column: str) -> DataFrame:
    """(case, steps, passed, ok): of each case (key, case, expected) how many steps have the expected value; missing steps fail, nulls may be expected."""
    met = cases.join(found.select(*key, F.col(column).alias("_found"), F.lit(True).alias("_there")), key, "left")
    hit = F.coalesce(F.col("_there"), F.lit(False)) & F.col("_found").eqNullSafe(F.col("expected"))
    return met.groupBy("case").agg(F.count("*").alias("steps"), F.sum(hit.cast("long")).alias("passed"), F.bool_and(hit).alias("ok"))


def threshold_sweep(rows: DataFrame, grid: list[float], labels: int, decide) -> DataFrame:
    """(threshold, micro_f1, macro_f1, samples_f1) of the decisions decide(threshold) about `truth`; one aggregate for all thresholds."""
    sums = []
    for k, t in enumerate(grid):
        chosen = decide(t)
        both = F.zip_with(chosen, F.col("truth"), lambda c, y: (c * y).cast("double"))
        size = F.zip_with(chosen, F.col("truth"), lambda c, y: (c + y).cast("double"))
        sums.append(F.avg(F.coalesce(F.try_divide(2 * total(both), total(size)), F.lit(0.0))).alias(f"f{k}"))
        for j in range(labels):
            sums += [F.sum(both[j]).alias(f"h{k}_{j}"), F.sum(size[j]).alias(f"s{k}_{j}")]
    one = rows.agg(*sums)
    points = []
    for k, t in enumerate(grid):
        h, s = ([F.col(f"{x}{k}_{j}") for j in range(labels)] for x in "hs")
        f1 = [F.coalesce(F.try_divide(2 * a, b), F.lit(0.0)) for a, b in zip(h, s)]
        points.append(F.struct(F.lit(t).alias("threshold"), F.coalesce(F.try_divide(2 * sum(h[1:], h[0]), sum(s[1:], s[0])), F.lit(0.0)).alias("micro_f1"), (sum(f1[1:], f1[0]) / labels).alias("macro_f1"), F.col(f"f{k}").alias("samples_f1")))
    return one.select(F.explode(F.array(*points)).alias("p")).select("p.*")


def best_by(rows: DataFrame, group: list[str], metric: str, ties: list[str]) -> DataFrame:
    """The row of each group with the largest `metric`; ties go to the smallest of `ties`."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*(group or [F.lit(1)])).orderBy(F.desc(metric), *ties)))
    return ranked.where(F.col("_r") == 1).drop("_r")


def chosen(rows: DataFrame, first: str, tolerance: float, second: str, ties: list[str]) -> DataFrame:
    """`rows` with `chosen`: of those within `tolerance` of the best `first`, the one of the best `second`; ties to the smallest of `ties`.

    rows: one row a candidate, a report.
    """
    top = rows.agg(F.max(first).alias("_top"))
    close = rows.crossJoin(F.broadcast(top)).withColumn("_close", F.col(first) >= F.col("_top") - tolerance)
    place = F.row_number().over(Window.orderBy(F.desc("_close"), F.desc(F.when(F.col("_close"), F.col(second))), *ties))
    return close.withColumn("chosen", F.col("_close") & (place == 1)).drop("_top", "_close")


def quantile(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): exact interpolated quantiles of the values that are not null.

    Values are counted first; running counts go over ranges of values, so no task holds all
    distinct ones. No values give nulls.
    """
    at = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    pieces = cut(at.repartitionByRange("v").withColumn("piece", F.spark_partition_id()))
    sizes = pieces.groupBy("piece").agg(F.sum("n").alias("pn"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("pn").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("piece", "before")
    inner = Window.partitionBy("piece").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = pieces.withColumn("c", F.sum("n").over(inner)).join(F.broadcast(offsets), "piece").select("v", "n", (F.col("c") + F.col("before")).alias("c"))
    wanted = sizes.agg(F.sum("pn").alias("all")).select("all", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("place", F.col("share") * (F.col("all") - 1))
    # The values at the places below and above, counted from 0; a value covers the places c - n up to c - 1.
    covers = lambda k: (F.col("c") > k) & (F.col("c") - F.col("n") <= k)
    low, high = F.floor("place"), F.ceil("place")
    met = running.crossJoin(F.broadcast(wanted)).groupBy("share").agg(F.max(F.when(covers(low), F.col("v"))).alias("low"), F.max(F.when(covers(high), F.col("v"))).alias("high"), F.max(F.col("place") - low).alias("part"))
    all_ = rows.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    return all_.join(F.broadcast(met), "share", "left").select("share", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))
