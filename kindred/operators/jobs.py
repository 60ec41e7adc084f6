"""The queue of embedding jobs: every transition is a projection of the jobs table and an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.sources.io import stable_id
from kindred.sources.schemas import JOBS, OPEN_JOB_STATUS

COLUMNS = [c.strip().split()[0] for c in JOBS.split(",")]


def queue_new_jobs(services: DataFrame, jobs: DataFrame, limit: int, now: Column) -> DataFrame:
    """Jobs for services without a vector that no unfinished job covers, by id."""
    open_jobs = jobs.where(F.col("status").isin(*OPEN_JOB_STATUS)).select(F.col("service_id").alias("id"))
    new = services.where("embedding_v2 is null").select("id").join(open_jobs, "id", "left_anti").orderBy("id").limit(limit)
    values = {"id": stable_id(F.lit("job"), F.col("id"), now), "service_id": F.col("id"), "status": F.lit("queued"), "created_at": now, "updated_at": now, "retry_count": F.lit(0)}
    types = {c.strip().split()[0]: c.strip().split()[1] for c in JOBS.split(",")}
    return new.select(*[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS])


def claim_jobs(jobs: DataFrame, worker: str, n: int, now: Column) -> DataFrame:
    """The oldest ``n`` queued jobs as fetched by a worker, in one batch. One writer claims at a time."""
    taken = jobs.where("status = 'queued' and worker_id is null").orderBy("created_at", "id").limit(n)
    return taken.withColumn("status", F.lit("fetched")).withColumn("worker_id", F.lit(worker)).withColumn("batch_id", stable_id(F.lit(worker), now)).withColumn("updated_at", now)


def claim_for_workers(jobs: DataFrame, capacity: DataFrame) -> DataFrame:
    """Deal queued jobs to several workers at once, oldest first: (worker_id, take) -> job id, worker_id, place.

    Workers take runs of the queue in id order.
    """
    w = Window.orderBy("worker_id").rowsBetween(Window.unboundedPreceding, -1)  # few rows: one a worker
    runs = capacity.withColumn("lo", F.coalesce(F.sum("take").over(w), F.lit(0))).withColumn("hi", F.col("lo") + F.col("take"))
    total = capacity.agg(F.coalesce(F.sum("take"), F.lit(0)).cast("int").alias("n")).first().n
    head = jobs.where("status = 'queued' and worker_id is null").orderBy("created_at", "id").limit(total)
    placed = head.select(F.col("id").alias("job_id"), (F.row_number().over(Window.orderBy("created_at", "id")) - 1).alias("place"))
    return placed.join(F.broadcast(runs), (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))).select("job_id", "worker_id", "place")


def apply_events(jobs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Jobs after status events (job_id, status, error, tokens, metadata), one a job.

    Failures count a retry; a null error or token count keeps the old one;
    metadata is replaced when given.
    """
    e = events.select(F.col("job_id").alias("id"), F.col("status").alias("_status"), F.col("error").alias("_error"), F.col("tokens").alias("_tokens"), F.col("metadata").alias("_metadata"))
    j = jobs.join(e, "id", "left")
    hit = F.col("_status").isNotNull()
    failed = hit & (F.col("_status") == "failed")
    new = {
        "status": F.coalesce("_status", "status"), "error_message": F.coalesce("_error", "error_message"), "input_tokens": F.coalesce("_tokens", "input_tokens"), "metadata": F.coalesce("_metadata", "metadata"),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "retry_count": F.col("retry_count") + failed.cast("int"), "last_retry_at": F.when(failed, now).otherwise(F.col("last_retry_at")),
    }
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in jobs.columns])


def is_stale(updated_at: Column, now: Column, minutes: int) -> Column:
    return updated_at < now - F.make_dt_interval(mins=F.lit(minutes))


def reset_stale(jobs: DataFrame, minutes: int, now: Column) -> DataFrame:
    """Jobs in processing for too long are queued again, without worker and batch."""
    old = (F.col("status") == "processing") & is_stale(F.col("updated_at"), now, minutes)
    note = F.concat(F.coalesce(F.concat("error_message", F.lit("; ")), F.lit("")), F.lit("reset: stale"))
    new = {"status": F.lit("queued"), "worker_id": F.lit(None).cast("string"), "batch_id": F.lit(None).cast("string"), "error_message": note, "updated_at": now}
    return jobs.select(*[F.when(old, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def settle_results(claimed: DataFrame, results: DataFrame) -> DataFrame:
    """Events of a batch: completed where a result (job_id, embedding, tokens) came back, else failed."""
    r = results.select("job_id", "embedding", "tokens")
    back = claimed.select(F.col("id").alias("job_id")).join(r, "job_id", "left")
    ok = F.col("embedding").isNotNull()
    return back.select("job_id", F.when(ok, "completed").otherwise("failed").alias("status"), F.when(~ok, "no result").alias("error"), "tokens", F.when(ok, F.to_json(F.struct(F.size("embedding").alias("dimensions")))).alias("metadata"))


def store_embeddings(services: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Services with their new vectors and the time of the change."""
    r = results.where("embedding is not null").select(F.col("service_id").alias("id"), F.col("embedding").alias("_e"))
    return services.join(r, "id", "left").withColumn("embedding_v2_updated_at", F.when(F.col("_e").isNotNull(), now).otherwise(F.col("embedding_v2_updated_at"))).withColumn("embedding_v2", F.coalesce("_e", "embedding_v2")).select(services.columns)
