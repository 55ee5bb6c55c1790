"""Read-through tables addressed by the content of their configuration, and the sinks of results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTICIPANTS = T.StructType([T.StructField(n, t) for n, t in (("participant_id", T.StringType()), ("Gender", T.StringType()), ("Age", T.DoubleType()), ("Group", T.StringType()), ("MMSE", T.IntegerType()))])
#: Fixed codes of the participants file.
GROUPS = {"A": ("AD", 0), "C": ("CN", 1), "F": ("FTD", 2)}


def key_of(config: Any) -> str:
    """First 10 hex digits of the SHA-1 of the configuration's sorted JSON."""
    return hashlib.sha1(json.dumps(asdict(config) if is_dataclass(config) else config, sort_keys=True, default=str).encode()).hexdigest()[:10]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is at path, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, root: str, name: str, config: Any, make: Callable[[], DataFrame], partition_by: tuple[str, ...] = (), force: bool = False) -> DataFrame:
    """The table of that configuration: read if finished, else made, written and read. The writer's commit makes it atomic."""
    path = f"{root.rstrip('/')}/{name}_{key_of(config)}"
    if force or not exists(spark, path):
        make().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def participants(spark: SparkSession, path: str) -> DataFrame:
    """subject, group, diagnosis, age, sex, label from a tab-separated file; the score column is dropped."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=PARTICIPANTS)
    at = lambda i: F.create_map(*[F.lit(x) for k, v in GROUPS.items() for x in (k, v[i])])[F.col("Group")]
    return raw.select(F.col("participant_id").alias("subject"), F.col("Group").alias("group"), at(0).alias("diagnosis"), F.col("Age").alias("age"), F.col("Gender").alias("sex"), at(1).alias("label"))


def require_subjects(store: DataFrame, expected: DataFrame) -> DataFrame:
    """store, or an error that names the first expected subject it lacks."""
    missing = expected.select("subject").distinct().join(store.select("subject").distinct(), "subject", "left_anti").orderBy("subject").first()
    if missing:
        raise FileNotFoundError(f"no rows of subject {missing.subject}")
    return store


def result_json(spark: SparkSession, pattern: str) -> DataFrame:
    """Every result file of a glob, with the name of its folder as key."""
    return spark.read.option("multiLine", True).json(pattern).withColumn("key", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def write_csv(df: DataFrame, path: str, digits: int = 5) -> None:
    """One CSV file of a report-sized table, fractions rounded."""
    df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def remaining(splits: DataFrame, done: DataFrame) -> DataFrame:
    """Splits (repeat, fold) without a checkpoint yet."""
    return splits.join(done.select("repeat", "fold").distinct(), ["repeat", "fold"], "left_anti")


def markdown(df: DataFrame) -> DataFrame:
    """A report-sized table as lines of Markdown, in the order of its rows."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("line"))
