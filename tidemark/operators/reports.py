"""Metrics and curves of out-of-fold predictions: rows of (repeat, fold, subject, y, k, p), one for each class k of each subject.

Counts are taken by (repeat, scope, class, probability) before anything is ordered, so a window orders distinct probabilities, not rows.
A scope is a whole repeat ("all") or one of its folds. A class without support has no recall and no AUC (null) and is left out of
their means; its precision and F1 are 0. Ties for the largest probability go to the smaller class. With two classes the macro AUC is that
of class 1. Nothing is rounded here; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.portable import duckdb_sql, frame, step

EPS = 1e-7
#: Places of the curves' common grid, both ends included.
POINTS = 201


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def class_bundle(proba: DataFrame) -> DataFrame:
    """repeat, scope, k, n, support, tp, predicted, recall, specificity, precision_, f1, auc, loss (the sum over the class's subjects)."""
    scope = F.explode(F.array(F.lit("all"), F.concat(F.lit("fold "), F.col("fold").cast("string")))).alias("scope")
    best = F.max(F.struct("p", (-F.col("k")).alias("m"))).over(Window.partitionBy("repeat", "scope", "subject"))
    rows = proba.select("repeat", scope, "subject", "y", "k", "p").withColumn("pred", -best["m"])
    own, chosen = F.col("y") == F.col("k"), F.col("pred") == F.col("k")
    loss = F.sum(F.when(own, -F.log(F.greatest(F.least("p", F.lit(1.0)), F.lit(EPS)))).otherwise(0.0))
    at = rows.groupBy("repeat", "scope", "k", "p").agg(_count(own).alias("pos"), _count(~own).alias("neg"), _count(own & chosen).alias("tp"), _count(chosen).alias("predicted"), loss.alias("loss"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("repeat", "scope", "k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = at.withColumn("won", F.col("pos") * (below + F.col("neg") / 2)).groupBy("repeat", "scope", "k").agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("won").alias("won"), F.sum("loss").alias("loss")
    )
    n, support, tp, predicted = (F.col(c) for c in ("n", "support", "tp", "predicted"))
    return sums.select(
        "repeat", "scope", "k", "n", "support", "tp", "predicted",
        F.try_divide(tp, support).alias("recall"),
        F.try_divide(n - support - predicted + tp, n - support).alias("specificity"),
        F.coalesce(F.try_divide(tp, predicted), F.lit(0.0)).alias("precision_"),
        F.coalesce(F.try_divide(2 * tp, support + predicted), F.lit(0.0)).alias("f1"),
        F.try_divide("won", support * (n - support)).alias("auc"),
        "loss",
    )


def metric_bundle(classes: DataFrame) -> DataFrame:
    """repeat, scope, n, balanced_accuracy, accuracy, macro_f1, log_loss, macro_auc of the rows of class_bundle."""
    n = F.max("n")
    auc = F.when(F.count(F.lit(1)) > 2, F.avg("auc")).otherwise(F.max(F.when(F.col("k") == 1, F.col("auc"))))
    return classes.groupBy("repeat", "scope").agg(
        n.alias("n"), F.avg("recall").alias("balanced_accuracy"), (F.sum("tp") / n).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum("loss") / n).alias("log_loss"), auc.alias("macro_auc")
    )


def roc_curves(proba: DataFrame, points: int = POINTS) -> DataFrame:
    """repeat, k, g, tpr: each repeat's curve of a class against the rest, linear between its points, at g / (points - 1).

    A stretch between two false positive rates names the places it covers by whole-number arithmetic, so no curve is joined with the
    grid. Where the curve rises upright at a place, its top counts. A class that a repeat has none or nothing but of gives no curve.
    """
    last = points - 1
    own = F.col("y") == F.col("k")
    every, down = Window.partitionBy("repeat", "k"), Window.partitionBy("repeat", "k").orderBy(F.desc("p"))
    at = proba.groupBy("repeat", "k", "p").agg(_count(own).alias("pos"), _count(~own).alias("neg"))
    steps = at.select("repeat", "k", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(every).alias("all_p"), F.sum("neg").over(every).alias("all_n"))
    tops = steps.where("all_p > 0 and all_n > 0").groupBy("repeat", "k", "fp", "all_p", "all_n").agg(F.min("tp").alias("low"), F.max("tp").alias("top"))
    along = Window.partitionBy("repeat", "k").orderBy("fp")
    runs = tops.withColumn("x0", F.lag("fp", 1, 0).over(along)).withColumn("y0", F.lag("top", 1, 0).over(along))
    first, until = (F.expr(f"({c} * {last} + all_n - 1) div all_n") for c in ("x0", "fp"))
    covered = F.when(until > first, F.sequence(first, until - 1)).otherwise(F.array().cast("array<bigint>"))
    places = F.explode(F.concat(covered, F.when(F.col("fp") == F.col("all_n"), F.array(F.lit(last).cast("long"))).otherwise(F.array().cast("array<bigint>")))).alias("g")
    share = F.try_divide(F.col("g") * F.col("all_n") / last - F.col("x0"), F.col("fp") - F.col("x0"))
    tpr = F.when(F.col("g") == last, F.lit(1.0)).otherwise((F.col("y0") + (F.col("low") - F.col("y0")) * share) / F.col("all_p"))
    return runs.select("repeat", "k", places, "x0", "y0", "fp", "low", "all_p", "all_n").select("repeat", "k", "g", tpr.alias("tpr"))


def roc_bands(curves: DataFrame) -> DataFrame:
    """k, g, tpr (the mean over repeats), lo and hi (2.5 and 97.5 per cent)."""
    return curves.groupBy("k", "g").agg(F.avg("tpr").alias("tpr"), F.percentile("tpr", F.lit(0.025)).alias("lo"), F.percentile("tpr", F.lit(0.975)).alias("hi"))


def roc_mean_auc(bands: DataFrame) -> DataFrame:
    """k, auc: the area under the mean curve by trapezoids."""
    ends = F.sum(F.when(F.col("before").isNull(), 0.0).otherwise((F.col("tpr") + F.col("before")) / 2 * (F.col("g") - F.col("g0"))))
    w = Window.partitionBy("k").orderBy("g")
    return bands.withColumn("before", F.lag("tpr").over(w)).withColumn("g0", F.lag("g").over(w)).groupBy("k").agg((ends / F.max("g")).alias("auc"))


# other ways to the same rows, for the reference engine: pairs for AUC, every place of the grid against every point for the curves
step("scored", "SELECT repeat, fold, subject, y, k, round(p, 9) AS p FROM {subject_proba}", public=False)
step("class_bundle_pairs", """
WITH a AS (SELECT repeat, concat('fold ', CAST(CAST(fold AS bigint) AS string)) AS scope, subject, y, k, p FROM {scored} UNION ALL SELECT repeat, 'all', subject, y, k, p FROM {scored}),
     v AS (SELECT repeat, scope, subject, min(y) AS y, (list(k ORDER BY p DESC, k))[1] AS pred FROM a GROUP BY repeat, scope, subject),
     c AS (SELECT v.repeat, v.scope, q.k, count(*) AS n, count(*) FILTER (y = k) AS support, count(*) FILTER (y = k AND pred = k) AS tp, count(*) FILTER (pred = k) AS predicted,
           count(*) FILTER (y <> k AND pred <> k) AS tn FROM v CROSS JOIN (SELECT DISTINCT k FROM a) q GROUP BY v.repeat, v.scope, q.k),
     u AS (SELECT x.repeat, x.scope, x.k, avg(CASE WHEN x.p > z.p THEN 1e0 WHEN x.p = z.p THEN 0.5e0 ELSE 0e0 END) AS auc FROM a x JOIN a z ON z.repeat = x.repeat AND z.scope = x.scope AND z.k = x.k AND z.y <> z.k
           WHERE x.y = x.k GROUP BY x.repeat, x.scope, x.k),
     l AS (SELECT repeat, scope, k, sum(-ln(greatest(least(p, 1), 1e-7))) AS loss FROM a WHERE y = k GROUP BY repeat, scope, k)
SELECT c.*, tp / nullif(support, 0) AS recall, tn / nullif(n - support, 0) AS specificity, coalesce(tp / nullif(predicted, 0), 0) AS precision_,
       CASE WHEN tp = 0 THEN 0 ELSE 2 / (1 / (tp / predicted) + 1 / (tp / support)) END AS f1, auc, coalesce(loss, 0) AS loss
FROM c LEFT JOIN u ON u.repeat = c.repeat AND u.scope = c.scope AND u.k = c.k LEFT JOIN l ON l.repeat = c.repeat AND l.scope = c.scope AND l.k = c.k""", public=False)
step("class_bundle_sql", """
SELECT repeat, scope, k, n, support, tp, predicted, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(precision_, 6) AS precision_, round(f1, 6) AS f1, round(auc, 6) AS auc, round(loss, 6) AS loss
FROM {class_bundle_pairs}""", public=False)
step("metric_bundle_sql", """
SELECT repeat, scope, max(n) AS n, round(avg(recall), 6) AS balanced_accuracy, round(CAST(sum(tp) AS double) / max(n), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(loss) / max(n), 6) AS log_loss, round(avg(auc), 6) AS macro_auc
FROM {class_bundle_pairs} GROUP BY repeat, scope""", public=False)
step("roc_bands_wide", """
SELECT k, g, avg(tpr) AS tpr, quantile_cont(tpr, 0.025) AS lo, quantile_cont(tpr, 0.975) AS hi FROM (
  SELECT repeat, k, g, CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (g / 200e0 - x0) / (x1 - x0) ELSE y0 END AS tpr FROM (
    SELECT repeat, k, g, max(CASE WHEN fpr <= g / 200e0 + 1e-12 THEN fpr ELSE 0 END) AS x0, max(CASE WHEN fpr <= g / 200e0 + 1e-12 THEN tpr ELSE 0 END) AS y0,
           min(CASE WHEN fpr > g / 200e0 + 1e-12 THEN fpr ELSE 1 END) AS x1, min(CASE WHEN fpr > g / 200e0 + 1e-12 THEN tpr ELSE 1 END) AS y1
    FROM {roc_points} CROSS JOIN (SELECT unnest(range(201)) AS g) GROUP BY repeat, k, g)) GROUP BY k, g""", public=False)
step("roc_bands_sql", "SELECT k, g, round(tpr, 6) AS tpr, round(lo, 6) AS lo, round(hi, 6) AS hi FROM {roc_bands_wide}", public=False)
step("roc_mean_auc_sql", "SELECT k, round((sum(tpr) - sum(CASE WHEN g = 0 OR g = 200 THEN tpr / 2 ELSE 0 END)) / 200, 6) AS auc FROM {roc_bands_wide} GROUP BY k", public=False)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: rounded(make(frame(spark, sf_dir, "scored")))

    return {
        "class_bundle": over(class_bundle),
        "metric_bundle": over(lambda p: metric_bundle(class_bundle(p))),
        "roc_bands": over(lambda p: roc_bands(roc_curves(p))),
        "roc_mean_auc": over(lambda p: roc_mean_auc(roc_bands(roc_curves(p)))),
    }


def oracle_sql() -> dict[str, str]:
    return {n: duckdb_sql(f"{n}_sql") for n in ("class_bundle", "metric_bundle", "roc_bands", "roc_mean_auc")}
