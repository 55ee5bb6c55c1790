"""Saved predictions and results: scans that know their schema, checks before models are compared, and the set of files of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.cache import write_csv


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def predictions(spark: SparkSession, path: str, classes: Sequence[str]) -> DataFrame | None:
    """Subject predictions of a run from CSV: repeat, fold, subject, y, p_<class>, n_epochs, params; None where there are none."""
    p = ", ".join(f"p_{c} double" for c in classes)
    return spark.read.csv(path, header=True, schema=f"repeat int, fold int, subject string, y int, {p}, n_epochs bigint, params string") if _there(spark, path) else None


def epoch_predictions(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """Epoch predictions of several members, with the member's number; None if any is missing, so that no vote is cast without it."""
    if not paths or not all(_there(spark, p) for p in paths):
        return None
    parts = [spark.read.parquet(p).withColumn("member", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def chunk_labels(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a JSON label file of that type, labels A, C, F as 0, 1, 2; other labels are an error."""
    raw = spark.read.option("multiLine", True).json(path).where(F.col("type") == kind)
    label = F.expr("case label when 'A' then 0 when 'C' then 1 when 'F' then 2 else cast(raise_error(concat('unknown label ', coalesce(label, 'null'))) as int) end")
    return raw.withColumn("y", label)


def require_alike(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b joined on repeat and subject for their common repeats; subjects or labels that differ are an error, not rows that vanish."""
    common = a.select("repeat").intersect(b.select("repeat"))
    x, y = a.join(common, "repeat", "left_semi"), b.join(common, "repeat", "left_semi")
    both = x.withColumnRenamed("y", "y_a").join(y.withColumnRenamed("y", "y_b"), ["repeat", "subject"], "full")
    ok = F.col("y_a").isNotNull() & F.col("y_b").isNotNull() & (F.col("y_a") == F.col("y_b"))
    return both.withColumn("y", F.when(ok, F.col("y_a")).otherwise(F.raise_error(F.concat(F.lit("subject differs between the models: "), F.col("subject").cast("string"))))).drop("y_a", "y_b")


def write_run(root: str, subjects: DataFrame, per_repeat: DataFrame, per_fold: DataFrame, summary: DataFrame) -> None:
    """The files of a run below root: subject predictions, metrics by repeat and by fold, and a summary of one row as JSON."""
    root = root.rstrip("/")
    write_csv(subjects, f"{root}/subject_predictions.csv")
    write_csv(per_repeat, f"{root}/metrics_per_repeat.csv")
    write_csv(per_fold, f"{root}/metrics_per_fold.csv")
    summary.coalesce(1).write.mode("overwrite").json(f"{root}/summary.json")
