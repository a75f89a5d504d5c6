"""Job and session state as tables: latest state, progress, recovery, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import constants as K

JOB_COLUMNS = ("state", "toc_ready", "rooms_ready", "rag_ready", "ts", "event_id")


def latest_state(log: DataFrame) -> DataFrame:
    """Last write per job wins; a partial aggregate, so a chatty job is not sorted in one task."""
    extra = [c for c in log.columns if c != "job_id" and c not in JOB_COLUMNS]
    if extra:
        raise ValueError(f"columns not allowed in a job update: {extra}")
    rest = [c for c in log.columns if c != "job_id"]
    return log.groupBy("job_id").agg(F.max_by(F.struct(*rest), "event_id").alias("r")).select("job_id", "r.*")


def progress(jobs: DataFrame) -> DataFrame:
    """(job_id, step, status, percent): three fixed steps per job, the first unfinished one may fail."""
    order = F.create_map(*[x for k, v in K.STATE_ORDER.items() for x in (F.lit(k), F.lit(v))])
    n = F.coalesce(order[F.col("state")], F.lit(0))
    later = F.col("rooms_ready") | F.col("rag_ready")
    done = [(later | F.col("toc_ready") if step == "preprocess" else later) | (n >= lim) for step, _, _, lim in K.PROGRESS_STEPS]
    percent = sum((F.when(d, w).otherwise(0) for d, (_, w, _, _) in zip(done, K.PROGRESS_STEPS)), F.lit(0))
    failed = F.col("state") == "FAILED"
    rows, open_before = [], F.lit(False)
    for i, (d, (step, _, active, _)) in enumerate(zip(done, K.PROGRESS_STEPS)):
        status = (F.when(d, "done").when(failed & ~open_before, "failed").when(~failed & (F.col("state") == active), "active").otherwise("pending"))
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(step).alias("step"), status.alias("status")))
        open_before = open_before | ~d
    return jobs.select(
        "job_id", F.when(F.col("state") == "DONE", 100).otherwise(percent).alias("percent"), F.inline(F.array(*rows)))


def recover(jobs: DataFrame) -> DataFrame:
    """Unfinished jobs in creation order: queued ones run again, interrupted ones fail."""
    return jobs.where(~F.col("state").isin("DONE", "FAILED")).withColumn(
        "action", F.when(F.col("state") == "QUEUED", "requeue").otherwise("fail")).orderBy("created_at", "job_id")
