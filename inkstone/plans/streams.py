"""Queries for stateful streams and their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.operators import jobs as J
from inkstone.plans import views as V
from inkstone.plans.registry import Tables, query
from inkstone.plans.sources import scratch
from inkstone.streaming import limits as LM
from inkstone.streaming import usage as US

L = F.lit
WINDOW_S, LIMIT = 6 * 3600.0, 2  # a scaled window: the events of a user are hours apart




RATE_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id NOT IN (3, 5)),
  r AS (SELECT user_id, event_id, us, rn, us AS st, 1 AS n FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.us, e.rn, CASE WHEN e.us - r.st >= {int(WINDOW_S * 1e6)} THEN e.us ELSE r.st END, CASE WHEN e.us - r.st >= {int(WINDOW_S * 1e6)} THEN 1 ELSE r.n + 1 END
    FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
  SELECT user_id, event_id, st AS window_start, CAST(n AS INTEGER) AS n, n > {LIMIT} AS limited, CASE WHEN n > {LIMIT} THEN greatest(1, CAST(trunc({WINDOW_S} - (us - st) / 1e6) AS INTEGER)) END AS retry_s FROM r"""


@query("rate_limit", RATE_SQL)
def rate_limit(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return LM.rate_limit(e, "user_id", "ts", "event_id", WINDOW_S, LIMIT, exempt=(3, 5))


HEARTBEAT = -1  # a key whose only event moves the watermark past the last event


@query("rate_limit_stream", RATE_SQL)
def rate_limit_stream(t):
    """The event log arrives in three parts, up to an hour out of order; each part is drained by a new start from the checkpoint."""
    parts, late_us = 3, 3600 * LM.MICRO
    e = t("events").where(~F.col("user_id").isin(3, 5)).select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if lo is None:
        return t.spark.createDataFrame([], LM.OUT).withColumnsRenamed({"k": "user_id", "id": "event_id"})
    arrival = F.unix_micros("ts") - lo + F.pmod(F.col("id"), F.lit(4)) * (late_us // 4)
    e = e.withColumn("part", F.least(F.lit(parts - 1), F.floor(arrival * parts / (hi - lo + 1))))
    beat = t.spark.range(1).select(F.lit(HEARTBEAT).cast("long").alias("k"), F.lit(0).cast("long").alias("id"), F.timestamp_micros(F.lit(hi + late_us + LM.MICRO)).alias("ts"))
    path = scratch(t, "rate-limit")
    for part in range(parts):
        rows = e.where(F.col("part") == part).drop("part")
        (rows.unionByName(beat) if part == parts - 1 else rows).write.mode("append").parquet(f"{path}/in")
        with US.state_store(t.spark, LM.ROCKSDB):
            stream = LM.rate_limit_stream(t.spark.readStream.schema("k long, id long, ts timestamp").parquet(f"{path}/in"), WINDOW_S, LIMIT, "1 hour")
            out = US.run_to_table(stream, "append", f"{path}/out", f"{path}/state")
    return out.where(F.col("k") != HEARTBEAT).withColumnsRenamed({"k": "user_id", "id": "event_id"})


@query("job_progress", """WITH f AS (SELECT *, CASE state WHEN 'PREPROCESSING' THEN 1 WHEN 'INDEXING' THEN 3 WHEN 'DONE' THEN 7 ELSE 0 END AS o, rooms_ready OR rag_ready AS late FROM v_latest_job),
  d AS (SELECT *, late OR toc_ready OR o >= 3 AS d0, late OR o >= 4 AS d1, late OR o >= 5 AS d2 FROM f),
  s AS (SELECT *, CASE WHEN state = 'DONE' THEN 100 ELSE 25 * d0::INT + 55 * d1::INT + 20 * d2::INT END AS percent FROM d)
  SELECT job_id, CAST(percent AS INTEGER) AS percent, 0 AS ord, 'preprocess' AS step, CASE WHEN d0 THEN 'done' WHEN state = 'FAILED' THEN 'failed' WHEN state = 'PREPROCESSING' THEN 'active' ELSE 'pending' END AS status FROM s
  UNION ALL SELECT job_id, percent, 1, 'indexing', CASE WHEN d1 THEN 'done' WHEN state = 'FAILED' AND d0 THEN 'failed' WHEN state = 'INDEXING' THEN 'active' ELSE 'pending' END FROM s
  UNION ALL SELECT job_id, percent, 2, 'rooms', CASE WHEN d2 THEN 'done' WHEN state = 'FAILED' AND d0 AND d1 THEN 'failed' ELSE 'pending' END FROM s""")
def job_progress(t):
    return J.progress(J.latest_state(V.job_log(t)))


@query("job_upsert", "SELECT * FROM v_latest_job_full")
def job_upsert(t):
    return J.latest_state(V.job_log(t)).drop("event_id")


def stream_of(t: Tables, table: str):
    """The table's files as a stream; new files in the folder would be new rows."""
    return t.spark.readStream.schema(t(table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.root)


class StreamTables(Tables):
    """Tables whose event log is read as a stream."""

    def __call__(self, name: str):
        return stream_of(Tables(self.spark, self.root), name) if name == "events" else super().__call__(name)


@query("usage_stream", """SELECT model, job_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(*) AS calls FROM v_usage GROUP BY ALL""")
def usage_stream(t):
    totals = US.usage_totals(V.usage(StreamTables(t.spark, t.root)))
    path = scratch(t, "usage-stream")
    return US.run_to_table(totals, "complete", f"{path}/out", f"{path}/state")


@query("job_upsert_stream", "SELECT * FROM v_latest_job_full")
def job_upsert_stream(t):
    path = scratch(t, "job-table")
    return US.upsert_stream(V.job_log(StreamTables(t.spark, t.root)), f"{path}/table", f"{path}/state", ["job_id"], "event_id").drop("event_id")


@query("session_expiry", "SELECT event_id, user_id FROM events WHERE epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM events) - 7::BIGINT * 24 * 3600 * 1000000")
def session_expiry(t):
    s = t("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    now = s.agg(F.max("ts").alias("now"))
    return US.fresh_sessions(s.join(F.broadcast(now)), F.col("now"), 7 * 24 * 3600).select("event_id", "user_id")  # one row
