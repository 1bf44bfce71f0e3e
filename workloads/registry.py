"""Where queries and their reference SQL are registered."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    """Register ``function(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """Register a SQL text whose tables stand in braces; the oracle is the same text unless given."""
    names = {field for _, field, _, _ in Formatter().parse(sql) if field}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})

    QUERIES[name] = run
    ORACLES[name] = oracle or sql.format(**{n: n for n in names})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
