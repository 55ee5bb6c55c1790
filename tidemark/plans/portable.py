"""Named relational steps: each is one declarative statement over earlier ones, planned by Catalyst as a whole.

A step's statement uses only what Spark SQL and other engines share, so a reference engine can check the same chain. Bases
are the points where engines differ (arrays, tables): they carry one form for each. A step may carry a form of its own for the
reference engine, another way to the same rows, so that the check is of the meaning and not of one text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

STEPS: dict[str, Step | Base] = {}
_NAME = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Base:
    spark: Callable[[SparkSession, str], DataFrame]
    duckdb: str


@dataclass(frozen=True)
class Step:
    sql: str
    public: bool = True
    duckdb: str | None = None

    @property
    def needs(self) -> list[str]:
        return list(dict.fromkeys(_NAME.findall(self.sql)))


def base(name: str, duckdb: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        STEPS[name] = Base(f, duckdb)
        return f

    return keep


def step(name: str, sql: str, public: bool = True, duckdb: str | None = None) -> None:
    STEPS[name] = Step(sql, public, duckdb)


def frame(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """The step as a DataFrame; known: steps given from outside, so that any step also runs over other data."""
    known = {} if known is None else known
    if name not in known:
        s = STEPS[name]
        known[name] = s.spark(spark, sf_dir) if isinstance(s, Base) else spark.sql(s.sql, **{n: frame(spark, sf_dir, n, known) for n in s.needs})
    return known[name]


def duckdb_sql(name: str) -> str:
    """The chain of steps up to name as one statement."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        if n in done:
            return
        s = STEPS[n]
        if isinstance(s, Step):
            text = s.duckdb or s.sql
            for x in _NAME.findall(text):
                add(x)
            text = _NAME.sub(r"\1", text).replace("percentile(", "quantile_cont(").replace("raise_error(", "error(")
        else:
            text = s.duckdb
        done[n] = text

    add(name)
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in done.items()) + f"\nSELECT * FROM {name}"
