"""Register of queries: how to run each, and the SQL text that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pactframe.sources.tables import Tables, binding_ctes

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    """Decorator: a function from bound tables to the result of query ``key``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if key in _QUERIES:
            raise ValueError(f"query {key} registered twice")
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = oracle
        return fn

    return add


def plain_types(df: DataFrame) -> DataFrame:
    """Zone-free timestamps and double decimals, so that any client reads the same values."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(field.name))
    return df.select(*out)


def _runner(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plain_types(fn(Tables(spark, sf_dir)))

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _runner(fn) for key, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {key: binding_ctes(sql) for key, sql in _ORACLES.items()}


def oracle_of(key: str) -> str:
    """The checking SQL of a query, without the bindings, for a query with the same answer."""
    return _ORACLES[key]
