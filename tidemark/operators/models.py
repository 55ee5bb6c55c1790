"""Distributed models by recipe. A recipe names its estimator; fitting is pyspark.ml's, over all executors.

A fold trains on the subjects of the other folds only, with weights that balance subjects and classes, and predicts its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.portable import frame


@dataclass(frozen=True)
class Recipe:
    make: Callable[[int], object]
    probability: bool = True


#: n: rows of the training folds; weights average 1, so the penalty is 1 / (C n).
RECIPES = {
    "lr": Recipe(lambda n: LogisticRegression(labelCol="label", featuresCol="scaled", weightCol="weight", regParam=1 / (0.01 * max(n, 1)), elasticNetParam=0.0, standardization=False)),
    "lr_en": Recipe(lambda n: LogisticRegression(labelCol="label", featuresCol="scaled", weightCol="weight", regParam=1 / (0.1 * max(n, 1)), elasticNetParam=0.5, standardization=False)),
    "rf": Recipe(lambda n: RandomForestClassifier(labelCol="label", featuresCol="scaled", weightCol="weight", numTrees=40, maxDepth=6, seed=7)),
    "linsvm": Recipe(lambda n: OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01), labelCol="label", featuresCol="scaled", weightCol="weight"), probability=False),
    "gbt": Recipe(lambda n: OneVsRest(classifier=GBTClassifier(maxIter=10, seed=7), labelCol="label", featuresCol="scaled", weightCol="weight"), probability=False),
}


def weighted(epochs: DataFrame) -> DataFrame:
    """weight: subjects of a class count alike, and classes do; the mean is 1."""
    per_class = epochs.groupBy("label").agg(F.countDistinct("subject").alias("_s"))
    n, k = epochs.count(), per_class.count()
    w = epochs.withColumn("_e", F.expr("count(*) over (partition by subject)")).join(F.broadcast(per_class), "label")
    return w.withColumn("weight", F.lit(n / max(k, 1)) / (F.col("_e") * F.col("_s"))).drop("_e", "_s")


def cross_validate(epochs: DataFrame, folds: DataFrame, recipe: str = "lr") -> DataFrame:
    """fold, subject, label, epoch, prediction (and proba) of every epoch of (subject, label, epoch, x), each by the model of the other folds."""
    spec, out = RECIPES[recipe], []
    data = weighted(epochs).join(folds.select("subject", "fold"), "subject").withColumn("features", array_to_vector("x")).withColumn("label", F.col("label").cast("double")).cache()
    for row in folds.select("fold").distinct().orderBy("fold").collect():  # folds are few by definition
        train, test = data.where(F.col("fold") != row.fold), data.where(F.col("fold") == row.fold)
        model = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), spec.make(train.count())]).fit(train)
        done = model.transform(test)
        extra = [vector_to_array("probability").alias("proba")] if spec.probability else []
        out.append(done.select(F.col("fold").cast("long").alias("fold"), "subject", F.col("label").cast("int").alias("label"), "epoch", F.col("prediction").cast("int").alias("prediction"), *extra))
    return reduce(DataFrame.unionByName, out)


def lr_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class task of the embeddings, first repeat."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label < 3")
    epochs = e.select((F.col("label") * 8 + F.col("vec_id") % 8).alias("subject"), "label", F.col("vec_id").alias("epoch"), F.expr("transform(embedding, x -> cast(x as double))").alias("x"))
    return cross_validate(epochs, frame(spark, sf_dir, "folds").where("repeat = 0"), "lr")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"lr_cv": lr_cv}
