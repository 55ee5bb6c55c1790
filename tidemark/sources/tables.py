"""Bases: the driver's tables in the shapes of the analysis.

A recording is a user's events in time order; an epoch is an embedding of 64 samples, or 4 channels of 16; a subject groups
embeddings of one label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.portable import base


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SAMPLES = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events"


@base("samples", _SAMPLES)
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.expr("cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint)").alias("i")
    return read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", i)


@base("window_samples", f"SELECT user_id, w AS epoch, i, value, event_type FROM (SELECT *, unnest(range(greatest(0, ((i - 16) // 8) + (CASE WHEN i < 16 THEN 0 ELSE 1 END)), i // 8 + 1)) AS w FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ({_SAMPLES}))) WHERE w * 8 + 16 <= n")
def window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample once for each full window (16 samples, step 8) that holds it: an arithmetic expansion, not a theta join."""
    s = samples(spark, sf_dir).withColumn("n", F.expr("count(*) over (partition by user_id)"))
    w = F.explode(F.expr("sequence(if(i < 16, 0L, (i - 16) div 8 + 1), i div 8)")).alias("epoch")
    return s.select("user_id", w, "i", "value", "event_type", "n").where("epoch * 8 + 16 <= n").select("user_id", "epoch", "i", "value", "event_type")


@base("cells", "SELECT label * 8 + vec_id % 8 AS subject, label, vec_id AS epoch, j - 1 AS j, embedding[j]::double AS v FROM (SELECT *, unnest(range(1, 65)) AS j FROM embeddings)")
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, label, epoch, j, v: every number of every epoch."""
    e = read(spark, sf_dir, "embeddings")
    return e.select((F.col("label") * 8 + F.col("vec_id") % 8).alias("subject"), "label", F.col("vec_id").alias("epoch"), F.posexplode("embedding").alias("j", "v")).withColumn("v", F.col("v").cast("double")).withColumn("j", F.col("j").cast("long"))


@base("epochs", "SELECT label * 8 + vec_id % 8 AS subject, label, vec_id AS epoch FROM embeddings")
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select((F.col("label") * 8 + F.col("vec_id") % 8).alias("subject"), "label", F.col("vec_id").alias("epoch"))


@base("bins", "SELECT unnest(range(33)) AS k")
def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency bins of a 64-sample epoch."""
    return spark.range(33).select(F.col("id").alias("k"))


@base("signals", "SELECT vec_id AS epoch, embedding AS x FROM embeddings")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch, x: every epoch as one array of doubles."""
    return read(spark, sf_dir, "embeddings").where("embedding is not null").selectExpr("vec_id as epoch", "transform(embedding, v -> cast(v as double)) as x")


@base("boot_numbers", "SELECT unnest(range(2000)) AS b")
def boot_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of the bootstrap."""
    return spark.range(2000).select(F.col("id").alias("b"))


@base("numbers", "SELECT unnest(range(100)) AS b")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of the permutation tests."""
    return spark.range(100).select(F.col("id").alias("b"))


@base("repeats", "SELECT unnest(range(10)) AS repeat")
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(10).select(F.col("id").alias("repeat"))


@base("props", "SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k')::bigint AS k FROM events")
def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _table(name: str) -> None:
    base(name, f"SELECT * FROM main.{name}")(lambda spark, sf_dir: read(spark, sf_dir, name))


for _name in ("orders", "lineitem", "part", "customer", "nation", "region", "supplier"):
    _table(_name)
