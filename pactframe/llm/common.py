"""Helpers shared by the operators on text tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Rows turned into Python objects at a time, so that long texts do not pile up.
CHUNK = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The rows without columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def extended(df: DataFrame, **added: str) -> T.StructType:
    """The schema of the rows with more columns."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return schema


def raw(text: str | Column) -> Column:
    """UTF-8 bytes of a text; a null text counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c, F.lit("")).cast("binary")


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, CHUNK):
        yield batch.slice(start, CHUNK)


def map_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema) -> DataFrame:
    """mapInArrow with state: ``start`` runs once per task and returns the batch function."""

    def run(batches):
        step = start()
        for batch in batches:
            for part in chunks(batch):
                out = step(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)
