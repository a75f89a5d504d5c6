"""Usage and job streams over appended files, and session expiry."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.sources import sinks


@contextlib.contextmanager
def state_store(spark: SparkSession, provider: str):
    """Streams started inside keep their state in stores of ``provider``."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_to_table(stream: DataFrame, mode: str, path: str, checkpoint: str) -> DataFrame:
    """Drain a stream with what is available now; every micro-batch replaces the result table.

    Results stay distributed: each batch is written by the executors, none pass the driver.
    """
    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    back = stream.sparkSession.read.parquet(path)
    if mode != "complete":
        return back.drop("epoch")
    last = back.agg(F.max("epoch").alias("last"))
    return back.join(F.broadcast(last), F.col("epoch") == F.col("last")).drop("epoch", "last")  # one row


def usage_totals(usage: DataFrame, watermark: str | None = None, window: str | None = None) -> DataFrame:
    """Tokens and calls by model and job; optionally by event-time window with late data bounded."""
    src = usage.withWatermark("ts", watermark) if watermark else usage
    keys = [F.window("ts", window).alias("win")] if window else []
    return src.groupBy(*keys, "model", "job_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls"))


def fresh_sessions(sessions: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """Sessions not older than the time to live."""
    return sessions.where(F.unix_micros(F.col("ts")) >= F.unix_micros(now) - ttl_seconds * 1_000_000)


def upsert_stream(updates: DataFrame, path: str, checkpoint: str, keys: list[str], version: str) -> DataFrame:
    """Last write wins per key: every micro-batch is merged into the buckets it touches, the others keep their files.

    The table before a batch is looked up in storage, so a restart from the checkpoint goes on where the last run
    ended, and a replayed batch rewrites its own version only. Returns the newest version, also when nothing was new.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        sinks.upsert_buckets(batch, path, epoch, keys, version)

    q = updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sinks.read_buckets(updates.sparkSession, path, updates.schema)
