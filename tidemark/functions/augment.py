"""Seeded augmentation of epochs: noise, scaling, dropped channels or nothing, by random numbers that are a function of the epoch and the draw.

A number is 32 bits of the md5 of (seed, purpose, epoch, draw, place), so a draw is alike on every cluster, partitioning and retry, and
needs no state. All of it is column expressions: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

import tidemark.sources.tables  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.portable import frame

#: Shares of the kinds (the rest stays as it is), range of the noise's deviation, range of the factor, most channels dropped.
NOISE, SCALING, DROPOUT, LEVEL, FACTOR, MOST = 0.3, 0.2, 0.1, (0.01, 0.05), (0.9, 1.1), 3


def uniform(seed: int, purpose: str, *keys: Column, part: int = 0) -> Column:
    """A number within 0 and 1, neither included."""
    text = F.md5(F.concat_ws("#", F.lit(str(seed)), F.lit(purpose), *(k.cast("string") for k in keys)))
    return (F.conv(F.substring(text, 1 + 8 * part, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def augmented(epochs: DataFrame, channels: int, draws: int = 1, seed: int = 0) -> DataFrame:
    """epoch, draw, kind, x of epochs (epoch, x: channels one after another), each epoch so many times; null x stays null."""
    e, d = F.col("epoch"), F.col("draw")
    rows = epochs.select("epoch", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), F.col("x").cast("array<double>").alias("x"))
    u = uniform(seed, "kind", e, d)
    kind = F.when(u < NOISE, "noise").when(u < NOISE + SCALING, "scaling").when(u < NOISE + SCALING + DROPOUT, "dropout").otherwise("none")

    def between(ends: tuple[float, float], purpose: str) -> Column:
        return ends[0] + (ends[1] - ends[0]) * uniform(seed, purpose, e, d)

    def normal(i: Column) -> Column:
        return F.sqrt(-2 * F.log(uniform(seed, "normal", e, d, i))) * F.cos(2 * F.pi() * uniform(seed, "normal", e, d, i, part=1))

    many = F.least(F.floor(uniform(seed, "many", e, d) * MOST) + 1, F.lit(channels)).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.struct(uniform(seed, "channel", e, d, c).alias("u"), c.alias("c"))))
    gone = F.transform(F.slice(order, F.lit(1), many), lambda s: s["c"])
    per = F.size("x") / channels
    noisy = F.transform("x", lambda v, i: v + F.col("level") * normal(i))
    fewer = F.transform("x", lambda v, i: F.when(F.array_contains("gone", F.floor(i / per).cast("int")), 0.0).otherwise(v))
    told = rows.withColumn("kind", kind).withColumn("level", between(LEVEL, "level")).withColumn("factor", between(FACTOR, "factor")).withColumn("gone", gone)
    x = F.when(F.col("kind") == "noise", noisy).when(F.col("kind") == "scaling", F.transform("x", lambda v: v * F.col("factor"))).when(F.col("kind") == "dropout", fewer).otherwise(F.col("x"))
    return told.select("epoch", "draw", "kind", x.alias("x"))


def augmented_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch, draw, kind, i, v: each embedding as 4 channels of 16 samples, drawn twice."""
    rows = augmented(frame(spark, sf_dir, "signals"), 4, 2, 7)
    return rows.select("epoch", F.col("draw").cast("long").alias("draw"), "kind", F.posexplode("x").alias("i", "v")).select("epoch", "draw", "kind", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


def _u(purpose: str, *more: str, part: int = 0) -> str:
    keys = ", ".join(f"'#', {k}::varchar" for k in ("epoch", "draw", *more))
    return f"((concat('0x', substring(md5(concat('7#{purpose}', {keys})), {1 + 8 * part}, 8))::bigint + 0.5) / 4294967296)"


#: Another way: samples as rows, dropped channels by rank.
SQL = f"""
WITH d AS (SELECT epoch, draw, embedding AS x, {_u("kind")} AS u, 0.01 + 0.04 * {_u("level")} AS level, 0.9 + 0.2 * {_u("factor")} AS factor, 1 + floor(3 * {_u("many")}) AS many
  FROM (SELECT vec_id AS epoch, embedding FROM embeddings) e, (SELECT unnest([0, 1]) AS draw) n WHERE embedding IS NOT NULL),
c AS (SELECT epoch, draw, c, row_number() OVER (PARTITION BY epoch, draw ORDER BY {_u("channel", "c")}, c) AS place FROM d, (SELECT unnest(range(4)) AS c)),
s AS (SELECT epoch, draw, u, level, factor, many, unnest(range(64)) AS i, unnest(x)::double AS v FROM d)
SELECT s.epoch, s.draw::bigint AS draw, CASE WHEN u < 0.3 THEN 'noise' WHEN u < 0.5 THEN 'scaling' WHEN u < 0.6 THEN 'dropout' ELSE 'none' END AS kind, i,
  round(CASE WHEN u < 0.3 THEN v + level * sqrt(-2 * ln({_u("normal", "i").replace("epoch::", "s.epoch::").replace("draw::", "s.draw::")})) * cos(2 * pi() * {_u("normal", "i", part=1).replace("epoch::", "s.epoch::").replace("draw::", "s.draw::")}) WHEN u < 0.5 THEN v * factor WHEN u < 0.6 AND c.place <= many THEN 0 ELSE v END, 6) AS v
FROM s JOIN c ON c.epoch = s.epoch AND c.draw = s.draw AND c.c = s.i // 16
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"augmented_samples": augmented_samples}


def oracle_sql() -> dict[str, str]:
    return {"augmented_samples": SQL}
