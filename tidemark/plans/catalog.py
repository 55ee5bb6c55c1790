"""Every registered query with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tidemark.functions.spectral
import tidemark.operators.evaluate
import tidemark.operators.protocol
import tidemark.operators.recording
import tidemark.operators.stats
import tidemark.operators.windows
import tidemark.sources.tables  # noqa: F401
from tidemark.functions import aperiodic, augment, continuous, extract, numeric
from tidemark.operators import curved, inputs, models, nested, reports
from tidemark.plans.portable import STEPS, Step, duckdb_sql, frame


def _public() -> list[str]:
    return [n for n, s in STEPS.items() if isinstance(s, Step) and s.public]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    steps = {n: (lambda spark, sf_dir, n=n: frame(spark, sf_dir, n)) for n in _public()}
    return steps | numeric.queries() | extract.queries() | aperiodic.queries() | continuous.queries() | augment.queries() | curved.queries() | models.queries() | nested.queries() | reports.queries() | inputs.queries()


def oracle_sql() -> dict[str, str]:
    return {n: duckdb_sql(n) for n in _public()} | nested.oracle_sql() | augment.oracle_sql() | reports.oracle_sql() | inputs.oracle_sql()
