"""Readers with fixed schemas, and the two append sinks."""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pactframe.session import new_folder
from pactframe.sources.bindings import BINDINGS
from pactframe.sources.schemas import BASE_SCHEMAS, DOMAIN_SCHEMAS


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One domain table stored as Parquet, with its declared schema."""
    return spark.read.schema(DOMAIN_SCHEMAS[table]).parquet(path)


def append_table(df: DataFrame, path: str, time_column: str = "created_at") -> None:
    """Append rows partitioned by day, so that time-bounded reads skip files.

    One shuffle by day and a spread of the busy days keeps the file count low
    without putting a whole day into one task.
    """
    rows = df.withColumn("day", F.to_date(time_column))
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(16))
    rows.repartition("day", spread).write.mode("append").partitionBy("day").parquet(path)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    For a result that several later steps use: it is computed once, and a lost
    executor does not make it be computed again.
    """
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def no_rows(spark: SparkSession, schema: StructType) -> DataFrame:
    """An empty table of the schema, known as such to the planner and made without Python workers."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def base_names(template: str) -> list[str]:
    """Placeholders of a binding text."""
    return sorted({name for _, name, _, _ in string.Formatter().parse(template) if name})


class Tables:
    """Domain tables bound to one folder of test parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        template = BINDINGS[name]
        return self.spark.sql(template, **{b: self.base(b) for b in base_names(template)})


def binding_ctes(sql: str) -> str:
    """Put the bindings a query mentions in front of it as common table expressions."""
    names = [n for n in BINDINGS if re.search(rf"\b{n}\b", sql)]
    if not names:
        return sql
    parts = []
    for n in names:
        text = BINDINGS[n]
        parts.append(f"{n} as ({text.format(**{b: b for b in base_names(text)})})")
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(parts) + ",\n" + body[15:]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body
