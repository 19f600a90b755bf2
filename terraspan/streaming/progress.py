"""Live attempt state and run progress over the stream of attempt events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import progress as pg
from ..operators import runs
from . import changes

DONE = runs.DONE


def live_progress(events: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Updates, finished files, bytes and speed per run and window, for a batch or a stream of events.

    On a stream the watermark bounds the state and closes windows ``delay`` after their end.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    frame = F.window("ts", window)
    totals = events.groupBy("run_id", frame.alias("_w")).agg(
        F.count(F.lit(1)).alias("updates"), F.count_if(F.col("status").isin(*DONE)).alias("completed_files"),
        F.count_if(F.col("status") == "failed").alias("failed_files"),
        F.sum(F.coalesce("downloaded_bytes", F.lit(0))).alias("downloaded_bytes"),
    )
    seconds = (F.unix_micros("_w.end") - F.unix_micros("_w.start")) / F.lit(1_000_000)
    return totals.select(
        "run_id", F.col("_w.start").alias("window_start"), "updates", "completed_files", "failed_files", "downloaded_bytes",
        pg.speed(F.col("downloaded_bytes"), seconds).alias("speed"),
    )


KEY, ORDER = ("attempt_id", "run_id"), ("updated_at", "seq")


def attempt_state_stream(events: DataFrame, path: str, checkpoint: str, idle_ms: int = changes.IDLE_MS, shards: int = changes.SHARDS):
    """Start a stream that keeps the newest state of each attempt.

    A micro-batch adds the states that are newer than what is known. What is known of a run is dropped once it has been silent for ``idle_ms``.
    """
    rows = events.select(
        "attempt_id", F.coalesce(F.col("run_id").cast("string"), F.lit("")).alias("run_key"), "run_id", "status",
        F.col("downloaded_bytes").cast("string").alias("downloaded_bytes"),
        F.coalesce("updated_at", F.lit("")).alias("updated_at"), F.coalesce("seq", F.lit(-1)).alias("seq"),
    )
    states = changes.winning_rows(rows, "run_key", KEY, ORDER, newest=True, idle_ms=idle_ms, shards=shards).drop("run_key")

    def write(batch: DataFrame, batch_id: int) -> None:
        changes.append_changes(batch, batch_id, path, KEY, ORDER)

    with changes.keyed_state(events.sparkSession):
        return states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_state(spark: SparkSession, path: str, target: str) -> None:
    """Write the current states at ``path`` as the first batch of a new table at ``target``.

    Run it while no stream writes, then go on with ``target``; the old table can be deleted.
    """
    changes.compact(spark, path, target, KEY, ORDER)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Current state of each attempt: all states but those replaced since."""
    return changes.current_rows(spark, path, KEY, ORDER).withColumn("downloaded_bytes", F.col("downloaded_bytes").cast("bigint"))


def attempt_state_snapshot(spark: SparkSession, folder: str, views) -> DataFrame:
    """Run the attempt events of ``folder`` through the state stream and return the state it reaches."""
    import uuid

    from ..session import scratch_dir

    schema = views.table("events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    home = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    attempt_state_stream(views.attempts(stream), f"{home}/state", f"{home}/checkpoint").awaitTermination()
    return read_state(spark, f"{home}/state")
