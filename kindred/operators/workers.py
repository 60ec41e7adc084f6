"""Workers: registry, load balancing and circuit breakers, over tables of workers and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.sources.io import merge, same_id
from kindred.sources.schemas import CAPABILITIES
from kindred.sources.storage import materialize

FAILURES, OPEN_SECONDS = 5, 300
RECENT = 50


def register(workers: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert of workers; kind and time of creation stay as first registered."""
    return merge(workers, seen, ["id"], keep=["worker_type", "created_at"])


def deregister(workers: DataFrame, gone: DataFrame) -> DataFrame:
    return workers.join(gone.select("id"), "id", "left_anti")


def heartbeat(workers: DataFrame, beats: DataFrame) -> DataFrame:
    """Workers with the latest beat (id, at, load, active_jobs); a beat brings a worker that was offline back."""
    last = beats.groupBy("id").agg(F.max("at").alias("_at"), F.max_by("load", "at").alias("_load"), F.max_by("active_jobs", "at").alias("_jobs"))
    j = workers.join(last, "id", "left")
    back = F.col("_at").isNotNull() & (F.col("status") == "offline")
    return j.withColumn("status", F.when(back, "online").otherwise(F.col("status"))).withColumn("last_heartbeat", F.greatest("_at", "last_heartbeat")).withColumn("current_load", F.coalesce("_load", "current_load")).withColumn("active_jobs", F.coalesce("_jobs", "active_jobs")).select(workers.columns)


def drop_stale(workers: DataFrame, now: Column, seconds: int) -> DataFrame:
    return workers.where(~(F.col("last_heartbeat") < now - F.make_dt_interval(secs=F.lit(seconds))))


def with_capabilities(workers: DataFrame) -> DataFrame:
    return workers.withColumn("caps", F.from_json("capabilities", CAPABILITIES))


def available(workers: DataFrame, breakers: DataFrame, size: int) -> DataFrame:
    """Workers that are online or busy, whose breaker lets calls through and who take batches of ``size``.

    ``breakers``: id, allows; workers without a row there are allowed.
    """
    w = with_capabilities(workers).join(breakers.select("id", "allows"), "id", "left")
    return w.where(F.col("status").isin("online", "busy") & F.coalesce("allows", F.lit(True)) & (F.col("caps.max_batch_size") >= size)).drop("allows")


def least_loaded(workers: DataFrame) -> DataFrame:
    return workers.agg(F.min_by("id", F.struct(F.coalesce("current_load", F.lit(0.0)), "id")).alias("id"))


def response_times(log: DataFrame, recent: int = RECENT) -> DataFrame:
    """Mean of each worker's last response times: log of worker_id, at, ms."""
    w = Window.partitionBy("worker_id").orderBy(F.col("at").desc(), F.col("ms"))
    return log.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= recent).groupBy("worker_id").agg(F.avg("ms").alias("mean_ms"))


def fastest(workers: DataFrame, log: DataFrame) -> DataFrame:
    """The worker of the smallest mean response time; workers never called come last."""
    t = workers.select("id").join(response_times(log).withColumnRenamed("worker_id", "id"), "id", "left")
    return t.agg(F.min_by("id", F.struct(F.coalesce("mean_ms", F.lit(float("inf"))), "id")).alias("id"))


def closest_batch(workers: DataFrame, size: int) -> DataFrame:
    """The worker whose best batch size is nearest."""
    return with_capabilities(workers).agg(F.min_by("id", F.struct(F.abs(F.col("caps.optimal_batch_size") - size), "id")).alias("id"))


def round_robin(items: DataFrame, item: str, workers: DataFrame) -> DataFrame:
    """Items dealt to workers in turn, by ids: item, worker_id.

    The place of an item is its rank; ranks come from counts of ranges, not
    from one sorted task.
    """
    ring = workers.agg(F.sort_array(F.collect_list("id")).alias("ring"))
    placed = global_rank(items, item)
    return placed.crossJoin(F.broadcast(ring)).select(item, F.element_at("ring", (F.pmod(F.col("rank") - 1, F.size("ring")) + 1).cast("int")).alias("worker_id"))


def global_rank(items: DataFrame, item: str) -> DataFrame:
    """Rank of each row by a column, from 1: ranks within ranges, plus the counts of ranges before."""
    dealt = items.select(item).repartitionByRange(item).sortWithinPartitions(item).withColumn("_p", F.spark_partition_id())
    within = Window.partitionBy("_p").orderBy(item)
    local = materialize(dealt.withColumn("_r", F.row_number().over(within)), "ranks")  # ranges are drawn once
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = local.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return local.join(F.broadcast(base.select("_p", "_base")), "_p").select(item, (F.col("_r") + F.col("_base")).alias("rank"))


def any_worker(workers: DataFrame, seed: Column) -> DataFrame:
    """A worker chosen by a hash, alike in every run of the same seed."""
    return workers.agg(F.min_by("id", F.xxhash64("id", seed)).alias("id"))


def breaker_states(events: DataFrame, now: Column, failures: int = FAILURES, open_seconds: int = OPEN_SECONDS) -> DataFrame:
    """State of every worker's breaker after its events (worker_id, at, ok): id, failures, state, allows.

    Failures since the last success open it; after ``open_seconds`` it is half
    open and lets a call through.
    """
    last_ok = F.max(F.when(F.col("ok"), F.struct("at", "seq")))
    e = events.withColumn("seq", F.monotonically_increasing_id() if "seq" not in events.columns else F.col("seq"))
    good = e.groupBy("worker_id").agg(last_ok.alias("_ok"))
    since = e.where("not ok").join(good, "worker_id").where(F.col("_ok").isNull() | (F.struct("at", "seq") > F.col("_ok"))).groupBy("worker_id").agg(F.count("*").alias("failures"), F.max("at").alias("_last"))
    all_ = good.select("worker_id").join(since, "worker_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    cold = now >= F.col("_last") + F.make_dt_interval(secs=F.lit(open_seconds))
    state = F.when(F.col("failures") < failures, "closed").when(cold, "half_open").otherwise("open")
    return all_.select(F.col("worker_id").alias("id"), "failures", state.alias("state"), (state != "open").alias("allows"))


def failure_runs(events: DataFrame) -> DataFrame:
    """Runs of failures between successes (gaps and islands): worker_id, run, failures, first_at, last_at."""
    w = Window.partitionBy("worker_id").orderBy("at", "event_id")
    e = events.withColumn("run", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(w))
    return e.where("not ok").groupBy("worker_id", "run").agg(F.count("*").alias("failures"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def capacity(workers: DataFrame, configured: int) -> DataFrame:
    """Jobs to fetch now: room of all workers, at least one, at most as configured."""
    t = with_capabilities(workers.where(F.col("status").isin("online", "busy"))).agg(F.coalesce(F.sum("caps.max_batch_size"), F.lit(0)).alias("total_capacity"), F.coalesce(F.sum("active_jobs"), F.lit(0)).alias("total_load"))
    return t.withColumn("take", F.least(F.greatest(F.lit(1), F.col("total_capacity") - F.col("total_load")), F.lit(configured)))


def status_summary(workers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active workers, and jobs waiting."""
    w = workers.agg(F.count(F.when(F.col("status").isin("online", "busy"), 1)).alias("active_workers"))
    return w.crossJoin(jobs.agg(F.count(F.when(F.col("status") == "queued", 1)).alias("queue_depth")))


def backoff_ms(attempt: Column) -> Column:
    return 100 * F.pow(F.lit(2), attempt - 1)


def same_worker(a: Column, b: Column) -> Column:
    return same_id(a, b)
