"""The registry of queries: a Spark plan over the fixtures and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register ``plan(fixtures)`` under ``name``; ``sql`` reads the named fixtures."""

    def add(plan: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, *tables)
        return plan

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0), so that sums in another order compare equal."""
    fix = lambda c: (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)
    return df.select(*(fix(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))
