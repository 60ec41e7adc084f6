"""Batch sizes of a worker: chosen from its measured latencies and memory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 100
WARM_UP = 5


def hardware_batches(gpu_gb: Column) -> tuple[Column, Column]:
    """Best and largest batch by graphics memory."""
    best = F.when(gpu_gb < 2, 4).when(gpu_gb < 4, 8).when(gpu_gb < 8, 16).when(gpu_gb < 24, 32).otherwise(64)
    return best, best * 2


def memory_bytes(batch: Column, tokens: int = 512, hidden: int = 384, layers: int = 12, heads: int = 12) -> Column:
    """Estimate of a batch's memory: activations of every layer and attention scores, in 32-bit floats."""
    return batch.cast("long") * (tokens * hidden * layers + heads * tokens * tokens) * 4


def latency_by_batch(log: DataFrame, recent: int | None = HISTORY) -> DataFrame:
    """Mean latency of each batch size over the last batches: log of worker_id, at, size, ms."""
    if recent is not None:
        w = Window.partitionBy("worker_id").orderBy(F.col("at").desc(), "size", "ms")
        log = log.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= recent)
    return log.groupBy("worker_id", "size").agg(F.avg("ms").alias("mean_ms"), F.count("*").alias("batches")).orderBy("worker_id", "size")


def largest_within(latency: DataFrame, target_ms: float) -> DataFrame:
    """For each worker the largest size before the first one that is too slow."""
    w = Window.partitionBy("worker_id").orderBy("size")
    ok = latency.withColumn("_late", F.max((F.col("mean_ms") > target_ms).cast("int")).over(w))
    return ok.where("_late = 0").groupBy("worker_id").agg(F.max("size").alias("best_size"))


def adjusted(size: Column, memory_percent: Column, compute_percent: Column, least: int, most: int) -> Column:
    """A size after looking at the load: a fifth less when memory is short, a fifth more when there is room."""
    new = F.when(memory_percent > 90, F.floor(size * 0.8)).when((compute_percent < 50) & (memory_percent < 70), F.ceil(size * 1.2)).otherwise(size)
    return F.greatest(F.least(new, F.lit(most)), F.lit(least)).cast("int")


def early_size(size: Column, memory_percent: Column, compute_percent: Column, free_bytes: Column, bytes_each: Column, least: int, most: int) -> Column:
    """The same while there are few measurements; also limited by free memory."""
    new = F.when(memory_percent > 85, F.floor(size * 0.8)).when((memory_percent < 60) & (compute_percent < 60), F.ceil(size * 1.2)).otherwise(size)
    return F.greatest(F.least(new, F.lit(most), F.floor(free_bytes / bytes_each)), F.lit(least)).cast("int")


def next_size(size: int, ok: bool, streak: int, least: int, cap: int) -> tuple[int, int]:
    """Size and streak after a batch: growth by a fifth, up to ``cap``, in the first successes; a quarter less after an error."""
    if not ok:
        return max(least, math.ceil(size * 0.75)), 0
    return (min(cap, math.ceil(size * 1.2)) if streak < WARM_UP else size), streak + 1


def replay_sizes(events: DataFrame, start: int, least: int, cap: int) -> DataFrame:
    """Size of each worker after its ordered events (worker_id, at, event_id, ok)."""
    ordered = events.groupBy("worker_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "ok"))).alias("e"))
    zero = F.struct(F.lit(start).alias("size"), F.lit(0).alias("streak"))

    def step(s, e):
        grown = F.when(s["streak"] < WARM_UP, F.least(F.lit(cap), F.ceil(s["size"] * 1.2).cast("int"))).otherwise(s["size"])
        shrunk = F.greatest(F.lit(least), F.ceil(s["size"] * 0.75).cast("int"))
        return F.struct(F.when(e["ok"], grown).otherwise(shrunk).alias("size"), F.when(e["ok"], s["streak"] + 1).otherwise(0).alias("streak"))

    return ordered.select("worker_id", F.aggregate("e", zero, step).alias("s")).select("worker_id", F.col("s.size").alias("batch_size"), F.col("s.streak").alias("streak"))


def suggested(n: Column, optimal: Column, least: int) -> Column:
    """Size for ``n`` waiting documents."""
    return F.when(n <= least, n).otherwise(F.least(optimal, n))


def chunked(items: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Items of a key cut into batches of ``size``: adds batch_no."""
    w = Window.partitionBy(key).orderBy(order)
    return items.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def last_samples(log: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last samples of each worker: log of worker_id, at, memory_percent."""
    w = Window.partitionBy("worker_id").orderBy(F.col("at").desc(), F.col("memory_percent"))
    return log.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def telemetry(log: DataFrame, n: int = HISTORY) -> DataFrame:
    """Peaks over all samples and means over the last ones; compute is estimated as four fifths of memory."""
    m = F.col("memory_percent")
    recent = last_samples(log, n).groupBy("worker_id").agg(F.avg(m).alias("mean_memory"), F.avg(0.8 * m).alias("mean_compute"), F.avg((m + 0.8 * m) / 2).alias("mean_utilisation"))
    peak = log.groupBy("worker_id").agg(F.max(m).alias("peak_memory"), F.sum(F.when(m > 90, 1).otherwise(0)).alias("throttle_events"), F.count("*").alias("samples"))
    return peak.join(recent, "worker_id")
