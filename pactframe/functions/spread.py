"""Helpers that keep one hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 32
_SALT = "_salt"


def salted_join(
    facts: DataFrame, lookup: DataFrame, on: list[str], spread_by: list[Column], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join facts to a smaller lookup with each key spread over several tasks.

    For joins that feed an aggregation on the same key: there the planner would
    reuse the key's partitioning, so the runtime skew split does not apply.
    The lookup rows are repeated once per salt; facts are never repeated.  The
    salt column stays in the result so that the first aggregation can use it.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return facts.withColumn(_SALT, salt).join(copies, [*on, _SALT], how)


def newest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the greatest by the order columns.

    The rank limit is applied in the map tasks too, so a hot key sends one row
    per task through the shuffle, and other columns are never compared.
    """
    return _first_per_key(rows, keys, [F.col(c).desc_nulls_last() for c in order])


def oldest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the smallest by the order columns."""
    return _first_per_key(rows, keys, [F.col(c).asc_nulls_last() for c in order])


def _first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")
