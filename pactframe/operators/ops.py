"""Operational telemetry reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactframe.functions.columns import half_up, instant, percent
from pactframe.operators.tenancy import in_scope


def health_columns() -> list[Column]:
    """Aggregates of the health view, shared by the batch and streaming form.

    The token sum skips a call with either count missing.  A call with unknown
    outcome counts as not successful.
    """
    duration = F.col("duration_ms")
    return [
        F.count(F.lit(1)).alias("ops"),
        half_up(F.sum(duration), F.count(duration)).alias("avg_ms"),
        F.expr("cast(percentile_disc(0.95) within group (order by duration_ms) as int)").alias("p95_ms"),
        percent(F.count_if("ok"), F.count(F.lit(1))).alias("success_pct"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"),
    ]


def last_24_hours(rows: DataFrame, as_of, column: str = "created_at") -> DataFrame:
    """Rows of the 24 hours up to ``as_of``; a row exactly 24 hours old is out.

    Rows after ``as_of`` did not exist then, so they are left out as well.
    """
    now = instant(as_of)
    return rows.filter((F.col(column) > now - F.expr("interval 24 hours")) & (F.col(column) <= now))


def ops_health(telemetry: DataFrame, as_of, scope: DataFrame | None = None) -> DataFrame:
    """Per minute and operation over the last 24 hours: volume, latency, success, tokens."""
    recent = last_24_hours(in_scope(telemetry, scope), as_of)
    return recent.groupBy(F.date_trunc("minute", "created_at").alias("minute"), "op").agg(*health_columns())


def error_classes(telemetry: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Failed calls per operation, worker and error class."""
    failed = in_scope(telemetry, scope).filter(~F.col("ok"))
    return failed.groupBy("op", "worker", "error_class").agg(F.count(F.lit(1)).alias("failures"))


def worker_summary(telemetry: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Processed and failed calls per worker and day."""
    rows = in_scope(telemetry, scope)
    return rows.groupBy("worker", F.to_date("created_at").alias("day")).agg(
        F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed")
    )
