"""As-of lookups and running totals that never order a whole key in one task.

A key's time line is cut into buckets.  Rows are ordered only inside a bucket;
what comes before is carried over as one row per bucket, so what is ordered
per key grows with the time that is covered and not with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pactframe.sources.tables import stored


def running_sum(changes: DataFrame, on: list[str], at: str, sums: list[str], bucket: str = "month") -> DataFrame:
    """Cumulative sums per key at every distinct instant, that instant included."""
    steps = changes.groupBy(*on, at).agg(*[F.sum(c).alias(c) for c in sums])
    steps = steps.withColumn("_bucket", F.date_trunc(bucket, at))
    totals = steps.groupBy(*on, "_bucket").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = W.partitionBy(*on).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*on, "_bucket", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = W.partitionBy(*on, "_bucket").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    local = steps.select(*on, at, "_bucket", *[F.sum(c).over(inside).alias(c) for c in sums])
    return local.join(carried, [*on, "_bucket"]).select(*on, at, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])


def following(asks: DataFrame, marks: DataFrame, on: list[str], at: str, bucket: str = "hour") -> DataFrame:
    """Each distinct (key, instant) of ``asks`` with ``next``, the first later instant of the key in ``marks``, or NULL."""
    flags = asks.select(*on, at, F.lit(1).alias("_ask"), F.lit(0).alias("_mark")).unionByName(
        marks.select(*on, at, F.lit(0).alias("_ask"), F.lit(1).alias("_mark")))
    line = flags.groupBy(*on, at).agg(F.max("_ask").alias("_ask"), F.max("_mark").alias("_mark")).withColumn("_bucket", F.date_trunc(bucket, at))
    line = line.withColumn("_at", F.when(F.col("_mark") == 1, F.col(at)))
    firsts = line.groupBy(*on, "_bucket").agg(F.min("_at").alias("_first"))
    later = W.partitionBy(*on).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    behind = firsts.select(*on, "_bucket", F.min("_first").over(later).alias("_behind"))
    inside = W.partitionBy(*on, "_bucket").orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, -1)
    near = line.withColumn("_near", F.min("_at").over(inside)).filter("_ask = 1")
    return near.join(behind, [*on, "_bucket"]).select(*on, at, F.coalesce("_near", "_behind").alias("next"))


def asof_lookup(asks: DataFrame, events: DataFrame, on: list[str], at: str, event_at: str, pick: list[str], bucket: str = "hour") -> DataFrame:
    """For each distinct (key, instant) asked, the newest event of the key that is not later.

    Gives ``on``, ``at`` and the ``pick`` columns, NULL where there is no such
    event.  Of events at the same instant the greatest by ``pick`` wins.  The
    common time line is used twice and is written to the shared folder first.
    """
    marks = (
        events.filter(F.col(event_at).isNotNull())
        .groupBy(*on, F.col(event_at).alias("_at"))
        .agg(F.max(F.struct(*pick)).alias("_event"))
        .withColumn("_ask", F.lit(0))
    )
    asked = (
        asks.filter(F.col(at).isNotNull())
        .select(*on, F.col(at).alias("_at"))
        .distinct()
        .withColumn("_event", F.lit(None).cast(marks.schema["_event"].dataType))
        .withColumn("_ask", F.lit(1))
    )
    line = marks.unionByName(asked).withColumn("_bucket", F.date_trunc(bucket, "_at"))
    line = stored(line, "time-line")
    inside = W.partitionBy(*on, "_bucket").orderBy("_at", "_ask").rowsBetween(W.unboundedPreceding, 0)
    seen = line.withColumn("_found", F.last("_event", ignorenulls=True).over(inside))
    ends = seen.groupBy(*on, "_bucket").agg(F.max_by("_found", F.struct("_at", "_ask")).alias("_end"))
    earlier = W.partitionBy(*on).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*on, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    answers = seen.filter(F.col("_ask") == 1).join(carried, [*on, "_bucket"])
    found = F.coalesce("_found", "_carried")
    return answers.select(*on, F.col("_at").alias(at), found.alias("_found")).select(*on, at, *[F.col(f"_found.{c}").alias(c) for c in pick])


def asof_join(
    probes: DataFrame, events: DataFrame, on: list[str], probe_at: str, event_at: str, pick: list[str], bucket: str = "hour"
) -> DataFrame:
    """Each probe with the newest event of its key that is not later than it.

    Adds the ``pick`` columns.  Probes at the same instant are looked up once,
    so a busy instant costs one row per map task.
    """
    answers = asof_lookup(probes, events, on, probe_at, event_at, pick, bucket)
    return probes.join(answers, [*on, probe_at], "left").select(*probes.columns, *pick)
