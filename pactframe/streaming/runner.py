"""Reading the append-only tables as streams and draining them to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pactframe.session import STATE_STORE, new_folder
from pactframe.sources.bindings import BINDINGS
from pactframe.sources.schemas import BASE_SCHEMAS


def base_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base test table as a stream; a Parquet stream reads a folder and a name pattern."""
    return (
        spark.readStream.schema(BASE_SCHEMAS[name])
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", 64)
        .parquet(folder)
    )


def events_in_parts(spark: SparkSession, folder: str, parts: int = 4) -> DataFrame:
    """The events as a stream of several files, one per micro-batch; some come a file late."""
    out = new_folder(spark, "events-in-parts")
    events = spark.read.schema(BASE_SCHEMAS["events"]).parquet(f"{folder}/events.parquet")
    newest = events.agg(F.max("event_id").alias("n")).first().n
    place = F.least(F.floor((F.col("event_id") + F.col("event_id") % 5 * 20) * parts / F.lit(newest + 1)), F.lit(parts - 1))
    for part in range(parts):
        events.filter(place == part).coalesce(1).write.mode("append").parquet(out)
    return spark.readStream.schema(BASE_SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(out)


def bound_stream(spark: SparkSession, folder: str, binding: str, base: str, in_parts: bool = False) -> DataFrame:
    """A domain table that derives from one base table, as a stream."""
    stream = events_in_parts(spark, folder) if in_parts and base == "events" else base_stream(spark, folder, base)
    return spark.sql(BINDINGS[binding], **{base: stream})


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now, into a Parquet table, and read it back.

    Table and checkpoint both live in the shared folder, so a lost executor or
    a restart resumes from the last committed batch.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = new_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, name: str, step: Callable[[DataFrame, int], None]) -> None:
    """Run ``step`` on every micro-batch of all that is there now."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", new_folder(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
