"""Samples of several modalities: arrays kept in one bucketed table each, so that a sample's arrays meet without a shuffle, and scaled by sample.

Every table is bucketed and sorted by the sample's name into the same number of buckets; joining them on it reads bucket by bucket. Arrays
are signals (channels of samples) or flat lists. The scaler is fitted within each sample: a signal's channels each, a list as a whole, to
mean 0 and population deviation 1 (constant ones to 0). All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed codes of the labels; what is neither A nor C is 2.
LABELS = {"A": 0, "C": 1}
BUCKETS = 64


def store(df: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Write (sample, x, ...) as the table of that name at path, bucketed by sample. Null samples can't be found again and raise."""
    known = F.coalesce(F.col("sample"), F.raise_error(F.lit("a sample without a name")).cast("string"))
    # one file a bucket: a sorted bucket of several files would be sorted again
    rows = df.withColumn("sample", known).repartition(buckets, "sample")
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "sample").sortBy("sample").option("path", path).saveAsTable(name)


def scaled(x: Column) -> Column:
    """A flat list to mean 0 and population deviation 1; null stays null, a constant list gives zeros."""
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    centred = F.transform(x, lambda v: v - mean)
    # the deviation is taken about the mean: sums of squares of large values would lose it
    spread = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)
    return F.when(n == 0, x).otherwise(F.transform(centred, lambda v: v / F.when(spread > 0, spread).otherwise(1.0)))


def load(spark: SparkSession, signal: str, others: Sequence[str], normalize: bool = True) -> DataFrame:
    """sample, label (number), time (channels of samples), and an array for each other table by its name.

    The signals' table says which samples there are; one that another table lacks is an error, not a row that vanishes.
    """
    if len(set(others)) != len(others):
        raise ValueError("modalities of one name")
    first = spark.table(signal).select("sample", "label", F.col("x").alias("time"))
    # merge: a broadcast would shuffle a table that lies in place
    parts = [spark.table(n).select("sample", F.col("x").alias(n)).hint("merge") for n in others]
    both = reduce(lambda a, b: a.join(b, "sample", "left"), parts, first)
    lacking = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("time", *others)]
    whole = F.when(F.coalesce(*lacking).isNotNull(), F.raise_error(F.concat(F.lit("sample "), F.col("sample"), F.lit(" lacks "), F.coalesce(*lacking))).cast("string")).otherwise(F.col("sample"))
    label = reduce(lambda c, kv: c.when(F.col("label") == kv[0], kv[1]), LABELS.items(), F).otherwise(2)
    time = F.transform("time", scaled) if normalize else F.col("time")
    return both.select(whole.alias("sample"), label.cast("int").alias("label"), time.alias("time"), *((scaled(F.col(n)) if normalize else F.col(n)).alias(n) for n in others))
