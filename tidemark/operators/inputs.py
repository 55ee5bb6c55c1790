"""A model's inputs: the features whose names match a pattern, cut from each epoch's array, and values of the subject behind them."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.portable import duckdb_sql, frame, step


def matching(names: Sequence[str], pattern: str) -> list[int]:
    """Places of the names in which the pattern occurs, in order; none is an error."""
    found = [i for i, n in enumerate(names) if re.search(pattern, n)]
    if not found:
        raise ValueError(f"no feature matches {pattern!r}")
    return found


def assembled(epochs: DataFrame, names: Sequence[str], pattern: str, extras: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """epochs (subject, label, epoch, x) with x cut to the matching features, then the extras' columns; and the names of all of x.

    extras: one row a subject of numbers. A subject without a row, or a null, gets NaN, which the imputer fills; two rows of a subject are
    an error. An array of another length than names is an error, a null one stays null. Epochs are not shuffled where the extras are small
    enough for the planner to send them out.
    """
    at = matching(names, pattern)
    fits = F.assert_true(F.col("x").isNull() | (F.size("x") == len(names)), f"an epoch has not {len(names)} features")
    cut = F.when(fits.isNull(), F.transform(F.array(*[F.lit(i + 1) for i in at]), lambda i: F.element_at("x", i))).cast("array<double>")
    out, columns = epochs.withColumn("x", F.when(F.col("x").isNotNull(), cut)), [names[i] for i in at]
    if extras is None:
        return out, columns
    more = [c for c in extras.columns if c != "subject"]
    one = F.assert_true(F.count(F.lit(1)) == 1, "a subject has two rows of extras")
    values = extras.groupBy("subject").agg(F.first(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in more])).alias("extra"), one.alias("one"))
    values = values.where(F.col("one").isNull()).select("subject", "extra")
    lacking = F.array(*[F.lit(float("nan")) for _ in more])
    return out.join(values, "subject", "left").select(*epochs.columns[:-1], F.concat("x", F.coalesce("extra", lacking)).alias("x")), columns + more


#: Subjects of the stand-in have the customer of their number behind them.
_EXTRAS = ("age", "sex_m")
_PATTERN = r"^rbp__m[0-2]__b2"


def feature_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, epoch, place, name, v of the three-class task: some named features of each epoch, then age and sex."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label < 3 and embedding is not null")
    epochs = e.select((F.col("label") * 8 + F.col("vec_id") % 8).alias("subject"), F.col("vec_id").alias("epoch"), F.col("embedding").alias("x"))
    # one row a feature
    names = [r.name for r in frame(spark, sf_dir, "feature_names").orderBy("j").collect()]
    x, columns = assembled(epochs, names, _PATTERN, frame(spark, sf_dir, "demographics").select("subject", *_EXTRAS))
    long = x.select("subject", "epoch", F.posexplode("x").alias("place", "v"))
    return long.select("subject", "epoch", F.col("place").cast("long").alias("place"), F.element_at(F.array(*map(F.lit, columns)), F.col("place") + 1).alias("name"), F.round(F.nanvl("v", F.lit(-1.0)), 6).alias("v"))


step("feature_inputs_sql", f"""
WITH f AS (SELECT name, j, row_number() OVER (ORDER BY j) - 1 AS place FROM {{feature_names}} WHERE regexp_matches(name, '{_PATTERN}')), n AS (SELECT count(*) AS n FROM f),
     e AS (SELECT DISTINCT subject, epoch FROM {{cells3}}), d AS (SELECT e.subject, e.epoch, c.age, c.sex_m FROM e LEFT JOIN {{demographics}} c ON c.subject = e.subject)
SELECT c.subject, c.epoch, f.place, f.name, round(c.v, 6) AS v FROM {{cells3}} c JOIN f ON f.j = c.j
UNION ALL SELECT subject, epoch, n, 'age', round(coalesce(age, -1), 6) FROM d CROSS JOIN n UNION ALL SELECT subject, epoch, n + 1, 'sex_m', round(coalesce(sex_m, -1), 6) FROM d CROSS JOIN n""", public=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"feature_inputs": feature_inputs}


def oracle_sql() -> dict[str, str]:
    return {"feature_inputs": duckdb_sql("feature_inputs_sql")}
