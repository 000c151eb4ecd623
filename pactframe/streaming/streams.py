"""Streaming forms of the operational reports.

Event times come from the data.  A window is emitted once the watermark has
passed its end, so a window that is still open at the end of the input is not
in the output.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from pactframe.functions.columns import percent
from pactframe.operators.jobs import clamp_progress, enqueue_decisions, failure_streaks
from pactframe.operators.ops import health_columns
from pactframe.sources.tables import no_rows

LATENESS = "10 minutes"


def stream_ops_health(telemetry: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Health per minute and operation, each minute once it is closed."""
    return (
        telemetry.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 minute").alias("w"), "op")
        .agg(*health_columns())
        .select(F.col("w.start").alias("minute"), "op", "ops", "avg_ms", "p95_ms", "success_pct", "tokens")
    )


def stream_call_budget(calls: DataFrame, cap: int = 60, lateness: str = LATENESS) -> DataFrame:
    """Calls per account and clock hour against the cap, each hour once it is closed."""
    return (
        calls.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 hour").alias("w"), "account_id")
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(
            "account_id",
            F.col("w.start").alias("hour"),
            "calls",
            F.least(F.col("calls"), F.lit(cap)).alias("allowed"),
            F.greatest(F.col("calls") - cap, F.lit(0)).alias("refused"),
        )
    )


def stream_ops_24h(telemetry: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Totals of the last 24 hours per operation, advancing hourly.

    Calls are first summed per hour; only those hourly rows are repeated for the
    24 windows they fall into.
    """
    hourly = (
        telemetry.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 hour").alias("hour"), "op")
        .agg(
            F.count(F.lit(1)).alias("ops"),
            F.count_if("ok").alias("good"),
            F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"),
        )
    )
    return (
        hourly.groupBy(F.window(F.window_time("hour"), "24 hours", "1 hour").alias("w"), "op")
        .agg(F.sum("ops").alias("ops"), F.sum("good").alias("good"), F.sum("tokens").alias("tokens"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "op",
            "ops",
            percent(F.col("good"), F.col("ops")).alias("success_pct"),
            "tokens",
        )
    )


class EnqueueBatches:
    """Requests against the live jobs and the keys accepted so far, for foreachBatch.

    Each batch is decided by the batch operator, with every key that an earlier
    batch accepted counting as a live job, however long ago that was.  Which
    keys are accepted does not depend on where batches are cut; of repeats that
    arrive in different batches the first to arrive wins.  Decisions are a table
    with a part per batch, and a repeated batch replaces its own.  Accepted keys
    are kept once more in ``BUCKETS`` folders by hash, of which a batch reads
    those of its own keys and no other column of any earlier decision.
    """

    BUCKETS = 16

    def __init__(self, folder: str, live: DataFrame, accounts: DataFrame, members: DataFrame):
        self.folder, self.live, self.accounts, self.members = folder, live, accounts, members

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("account_id", "idempotency_key"), F.lit(self.BUCKETS)).cast("int")
        known = self.live.select("account_id", "idempotency_key", "status")
        if batch_id > 0:
            asked = [r[0] for r in batch.filter("idempotency_key is not null").select(bucket).distinct().collect()]
            earlier = batch_parts(batch.sparkSession, f"{self.folder}/keys", known.select("account_id", "idempotency_key").schema)
            earlier = earlier.filter(F.col("bucket").isin(*asked) & (F.col("batch") < batch_id))
            known = known.unionByName(earlier.select("account_id", "idempotency_key", F.lit("queued").alias("status")))
        decided = enqueue_decisions(batch, known, self.accounts, self.members)
        out = f"{self.folder}/out/batch={batch_id}"
        decided.write.mode("overwrite").parquet(out)
        accepted = batch.sparkSession.read.schema(decided.schema).parquet(out).filter((F.col("outcome") == "queued") & F.col("idempotency_key").isNotNull())
        keys = accepted.select("account_id", "idempotency_key", bucket.alias("bucket"))
        keys.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/keys/batch={batch_id}")


def batch_parts(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The parts of all batches below a folder, with ``batch`` and ``bucket``; none if no batch has written there."""
    full = StructType([*schema.fields, StructField("batch", IntegerType()), StructField("bucket", IntegerType())])
    try:
        return spark.read.schema(full).parquet(folder)
    except AnalysisException:
        return no_rows(spark, full)


def last_done(spark: SparkSession, folder: str) -> tuple[int, object]:
    """The last batch whose parts are complete, and the value kept with it; -1 and None before the first."""
    try:
        row = spark.read.schema("batch long, value timestamp").parquet(f"{folder}/done").orderBy(F.desc("batch")).first()
    except AnalysisException:
        return -1, None
    return (-1, None) if row is None else (row["batch"], row["value"])


def mark_done(spark: SparkSession, folder: str, batch_id: int, value=None) -> None:
    row = spark.range(1, numPartitions=1).select(F.lit(batch_id).cast("long").alias("batch"), F.lit(value).cast("timestamp").alias("value"))
    row.write.mode("append").parquet(f"{folder}/done")


class StreakBatches:
    """Failure streaks over micro-batches, for foreachBatch.

    Calls wait until the newest call is ``lateness`` ahead of them, so within
    that bound they may come in any order and in any batches.  Those that are
    due are then handled by the batch operator, so a busy worker is still cut
    into many tasks, and one row per worker, its open streak, is carried on.

    A batch writes two tables, a part each, which a repeated batch replaces:
    the streaks, and what it keeps: calls that wait, open streaks, and calls
    later than the bound (``late``).  All state is in the folder, so the stream
    goes on from there after a restart.  ``finish`` handles what still waits
    when the stream is over.
    """

    CALLS = ["worker", "created_at", "id", "ok", "retryable"]

    def __init__(self, folder: str, threshold: int = 4, hold: str = "60 seconds", lateness: str = LATENESS):
        self.folder, self.threshold, self.hold, self.lateness = folder, threshold, hold, lateness

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._step(batch.select(*self.CALLS), batch_id, False)

    def finish(self, spark: SparkSession) -> None:
        last, _ = last_done(spark, self.folder)
        if last >= 0:
            self._step(self._kept(spark, last, "waiting").limit(0), last + 1, True)

    def late(self, spark: SparkSession) -> DataFrame:
        """Calls that came later than the bound."""
        return spark.read.parquet(f"{self.folder}/kept").filter("kind = 'late'").select(*self.CALLS)

    def _kept(self, spark: SparkSession, batch_id: int, kind: str) -> DataFrame:
        rows = spark.read.parquet(f"{self.folder}/kept/batch={batch_id}").filter(F.col("kind") == kind)
        return rows.select("worker", "open") if kind == "state" else rows.select(*self.CALLS)

    def _step(self, batch: DataFrame, batch_id: int, everything: bool) -> None:
        spark, folder = batch.sparkSession, self.folder
        late = batch.limit(0)
        if batch_id > 0:
            done = spark.read.schema("batch long, value timestamp").parquet(f"{folder}/done")
            passed = done.filter(F.col("batch") == batch_id - 1).first()["value"]
            waiting, carried = self._kept(spark, batch_id - 1, "waiting"), self._kept(spark, batch_id - 1, "state")
        else:
            waiting, passed = batch.limit(0), None
            carried = batch.limit(0).select("worker", F.lit(0).cast("long").alias("open"))
        if passed is not None:
            late = batch.filter(F.col("created_at") < F.lit(passed))
            batch = batch.filter((F.col("created_at") >= F.lit(passed)) | F.col("created_at").isNull())
        rows = waiting.unionByName(batch)
        newest = batch.agg(F.max(F.col("created_at") - F.expr(f"interval {self.lateness}")).alias("mark")).first().mark
        mark = max((m for m in (newest, passed) if m is not None), default=None)
        is_due = F.lit(True) if everything else F.coalesce(F.col("created_at") < F.lit(mark), F.lit(False))
        due = rows.filter(is_due)

        streaks = failure_streaks(due, self.threshold, self.hold, carried=carried)
        streaks.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

        done = spark.read.parquet(f"{folder}/out/batch={batch_id}")
        wins = due.filter("ok").groupBy("worker").agg(F.max(F.struct("created_at", "id")).alias("_last"))
        last = done.groupBy("worker").agg(F.max_by("streak", F.struct("created_at", "id")).alias("_streak"), F.max(F.struct("created_at", "id")).alias("_at"))
        state = carried.join(wins, "worker", "full").join(last, "worker", "full").select(
            "worker",
            F.when(F.col("_at").isNotNull() & (F.col("_last").isNull() | (F.col("_at") > F.col("_last"))), F.col("_streak"))
            .when(F.col("_last").isNotNull(), 0).otherwise(F.coalesce("open", F.lit(0))).cast("long").alias("open"),
        )
        kept = rows.filter(~is_due).withColumn("kind", F.lit("waiting")).unionByName(late.withColumn("kind", F.lit("late")))
        kept = kept.unionByName(state.withColumn("kind", F.lit("state")), allowMissingColumns=True)
        kept.write.mode("overwrite").parquet(f"{folder}/kept/batch={batch_id}")
        mark_done(spark, folder, batch_id, mark)


class JobStateBatches:
    """Lifecycle events folded into one state per job, for foreachBatch.

    Every rule compares (time, sequence) and keeps a maximum or a sum, so events
    may come in any order and in any batches, and a batch needs no state of the
    batches before: it writes the fold of its own events, in a part which a
    repeated batch replaces.  ``states`` merges the parts.  ``fold`` merges them
    into one for good, whenever there is time; claims before a later requeue of
    their job are dropped then.  All state is in the folder, so nothing is lost
    in a restart.
    """

    def __init__(self, folder: str, max_attempts: int = 5):
        self.folder, self.max_attempts = folder, max_attempts

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        at, action = F.struct("ts", "seq"), F.col("action")
        progress = F.when(action == "progress", clamp_progress(F.col("progress"))).when(action == "complete", 100).when(action == "requeue", 0)

        def newest(value, given):
            return F.max(F.when(given, F.struct("ts", "seq", value.alias("value"))))

        state = batch.groupBy("job_id").agg(
            newest(action, action != "progress").alias("last"),
            newest(progress, progress.isNotNull()).alias("progress"),
            newest(F.col("note"), F.col("note").isNotNull()).alias("note"),
            F.max(F.when(action == "requeue", at)).alias("requeued"),
            F.count(F.lit(1)).alias("events"),
        )
        state.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch_id}")
        claims = batch.filter(action == "claim").select("job_id", "ts", "seq")
        claims.write.mode("overwrite").parquet(f"{self.folder}/claims/batch={batch_id}")

    def _merged(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """State per job and its claims since the last requeue, of the last fold and all batches after it."""
        upto, _ = last_done(spark, self.folder)
        parts = []
        for kind in ("state", "claims"):
            rows = spark.read.parquet(f"{self.folder}/{kind}")
            later = rows.filter(F.col("batch") > upto).drop("batch")
            parts.append(later if upto < 0 else later.unionByName(spark.read.schema(later.schema).parquet(f"{self.folder}/folded-{kind}/upto={upto}")))
        state = parts[0].groupBy("job_id").agg(
            *[F.max(c).alias(c) for c in ("last", "progress", "note", "requeued")], F.sum("events").alias("events"))
        requeued = state.select("job_id", "requeued").filter("requeued is not null")
        since = parts[1].join(requeued, "job_id", "left").filter(F.col("requeued").isNull() | (F.struct("ts", "seq") > F.col("requeued")))
        return state, since.select("job_id", "ts", "seq")

    def fold(self, spark: SparkSession) -> None:
        """Merge the parts of all batches so far; call it between batches."""
        newest = spark.read.parquet(f"{self.folder}/state").agg(F.max("batch")).first()[0]
        upto, _ = last_done(spark, self.folder)
        if newest is None or newest <= upto:
            return
        for kind, rows in zip(("state", "claims"), self._merged(spark)):
            rows.write.mode("overwrite").parquet(f"{self.folder}/folded-{kind}/upto={newest}")
        mark_done(spark, self.folder, newest)

    def states(self, spark: SparkSession) -> DataFrame:
        """The current state of every job, as the batch operator gives it."""
        state, claims = self._merged(spark)
        tries = claims.groupBy("job_id").agg(F.count(F.lit(1)).alias("attempts"))
        attempts = F.coalesce("attempts", F.lit(0))
        last = F.col("last.value")
        status = (
            F.when(last == "claim", "running").when(last == "complete", "succeeded")
            .when((last == "fail") & (attempts >= self.max_attempts), "dead").otherwise("queued")
        )
        return state.join(tries, "job_id", "left").select(
            "job_id", status.alias("status"), attempts.alias("attempts"), F.coalesce("progress.value", F.lit(0)).alias("progress"),
            F.col("note.value").alias("note"), "events")


class DailySink:
    """Rows appended to a table in folders by day, for foreachBatch; a repeated batch changes nothing.

    Each batch has a folder of its own in every day it has rows of, which a
    repetition replaces.  ``compact`` writes the folders of a day that have
    gathered as one and then publishes up to which batch it goes; ``read`` takes
    that and the batches after it.  Only days with new folders are written
    again.  A row without a time goes to the day NULL.
    """

    UNKNOWN = "none"

    def __init__(self, folder: str, time_column: str = "created_at"):
        self.folder, self.time_column = folder, time_column

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        day = F.coalesce(F.date_format(self.time_column, "yyyy-MM-dd"), F.lit(self.UNKNOWN))
        rows = batch.withColumn("day", day)
        # a batch spans few days; busy ones are spread
        spread = F.pmod(F.xxhash64(*batch.columns), F.lit(4))
        rows.repartition("day", spread).write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/parts/batch={batch_id}")

    def _published(self, spark: SparkSession) -> DataFrame:
        """(day, upto): the last batch that the compacted folder of a day holds."""
        try:
            rows = spark.read.schema("day string, upto long").parquet(f"{self.folder}/published")
        except AnalysisException:
            rows = no_rows(spark, StructType([StructField("day", StringType()), StructField("upto", LongType())]))
        return rows.groupBy("day").agg(F.max("upto").alias("upto"))

    def _parts(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """Rows of batches that no compacted folder holds yet, with day and batch."""
        full = StructType([*schema.fields, StructField("batch", LongType()), StructField("day", StringType())])
        try:
            rows = spark.read.schema(full).parquet(f"{self.folder}/parts")
        except AnalysisException:
            rows = no_rows(spark, full)
        return rows.join(self._published(spark), "day", "left").filter(F.col("batch") > F.coalesce("upto", F.lit(-1))).select(*full.names)

    def _whole(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """Rows of the compacted folders, with day."""
        full = StructType([*schema.fields, StructField("upto", LongType()), StructField("day", StringType())])
        try:
            rows = spark.read.schema(full).parquet(f"{self.folder}/compacted")
        except AnalysisException:
            rows = no_rows(spark, full)
        return rows.join(self._published(spark), ["day", "upto"], "left_semi").select(*schema.names, "day")

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """All rows, each once, with their ``day`` (NULL without a time)."""
        rows = self._whole(spark, schema).unionByName(self._parts(spark, schema).drop("batch"))
        return rows.withColumn("day", F.when(F.col("day") != self.UNKNOWN, F.to_date("day")))

    def compact(self, spark: SparkSession, schema: StructType, least: int = 2) -> list[str]:
        """Write days with at least ``least`` folders as one; call it between batches.  The days that were written."""
        parts = self._parts(spark, schema)
        newest = parts.agg(F.max("batch")).first()[0]
        days = sorted(r["day"] for r in parts.groupBy("day").agg(F.count_distinct("batch").alias("n")).filter(F.col("n") >= least).select("day").toLocalIterator())
        if not days:
            return days
        wanted = F.col("day").isin(*days)
        rows = self._whole(spark, schema).filter(wanted).unionByName(parts.filter(wanted).drop("batch"))
        spread = F.pmod(F.xxhash64(*schema.names), F.lit(4))
        rows.repartition("day", spread).write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/compacted/upto={newest}")
        done = spark.createDataFrame([(d, newest) for d in days], "day string, upto long")
        done.coalesce(1).write.mode("append").parquet(f"{self.folder}/published")
        return days


def stream_stale_jobs(changes: DataFrame, stale_after: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    """One alert whenever a running job goes without a sign of life for too long.

    ``changes`` has (id, at, status): heartbeats with the status running, and
    the moment a job ends with any other.  Signs closer together than the limit
    form one session; it closes when the watermark has passed the limit after
    its last sign, and raises an alert unless that one ended the job.
    """
    ended = F.col("status") != "running"
    return (
        changes.select("id", "at", ended.alias("ended"))
        .withWatermark("at", lateness)
        .groupBy("id", F.session_window("at", stale_after).alias("w"))
        .agg(F.max(F.struct("at", "ended")).alias("last"))
        .filter(~F.col("last.ended"))
        .select("id", F.col("last.at").alias("last_heartbeat"), F.col("w.end").alias("stale_at"))
    )


def stream_stale_timers(changes: DataFrame, stale_after: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    """An alert for each job when the timer set by its last sign of life runs out.

    ``changes`` is as in ``stream_stale_jobs``.  The open spans of a job, with no
    gap between signs above ``stale_after``, are the state: session windows that
    reach a microsecond further, so that a gap of just ``stale_after`` is no
    alert.  A beat that comes late but within the watermark joins the spans
    around it and so sets the timer anew; the end of a job takes the alert
    away.  A timer runs out, and the alert is given, in the first batch whose
    watermark is beyond it, also if no job has news then.  Signs without job or
    time are none; answers do not depend on where batches are cut.  A span is
    one row of state however many signs it has, and no Python runs per job.
    """
    ended = F.coalesce(F.col("status") != "running", F.lit(True))
    return (
        changes.where("id is not null and at is not null")
        .select("id", "at", ended.alias("over"))
        .withWatermark("at", lateness)
        .groupBy("id", F.session_window("at", f"{stale_after} 1 microsecond").alias("w"))
        .agg(F.min("at").alias("alive_since"), F.max(F.struct("at", "over")).alias("last"))
        .filter(~F.col("last.over"))
        .select("id", "alive_since", F.col("last.at").alias("last_heartbeat"), (F.col("last.at") + F.expr(f"interval {stale_after}")).alias("stale_at"))
    )
