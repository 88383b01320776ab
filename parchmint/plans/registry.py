"""Every query of the engine's own operators, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parchmint.plans import more_queries, row_queries, text_queries
from parchmint.plans.dialect import DUCK, Dialect, Spark
from parchmint.session import SPREAD

Query = Callable[[SparkSession, str], DataFrame]
TWINS: dict[str, Callable[[Dialect], str]] = {"flagship": text_queries.flagship} | text_queries.QUERIES | more_queries.QUERIES


def runs(twin: Callable[[Dialect], str]) -> Query:
    return lambda spark, sf_dir: spark.sql(twin(Spark(sf_dir, int(spark.conf.get(SPREAD, "0")), spark)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(text_queries.flagship)(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: runs(twin) for name, twin in TWINS.items()} | row_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: twin(DUCK) for name, twin in TWINS.items()} | row_queries.ORACLES
