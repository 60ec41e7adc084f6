"""One run of the embedding queue: new jobs, claim, texts, vectors, results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.documents import document_text, fallback_tokens, shortened
from kindred.operators import encoder, jobs, workers
from kindred.operators.encoder import HashingEncoder
from kindred.sources.io import merge
from kindred.sources.settings import OrchestratorSettings, TokenizerSettings
from kindred.sources.storage import materialize


@dataclass
class EmbeddingRun:
    jobs: DataFrame
    services: DataFrame
    stats: DataFrame


def prepared_texts(services: DataFrame, strategy: str = "intelligent", settings: TokenizerSettings = TokenizerSettings()) -> DataFrame:
    """Services (id, name, description, taxonomies, url) as texts within the limit: id, text, tokens."""
    text = document_text(F.col("name"), F.col("description"), F.col("taxonomies"), F.col("url") if settings.include_url else None)
    return services.select("id", shortened(text, strategy, settings.max_tokens).alias("text")).withColumn("tokens", fallback_tokens(F.col("text")))


def sub_batch(worker_rows: DataFrame, default: int = 10) -> int:
    """Documents of a call: the smallest best batch of the workers that are online."""
    best = workers.with_capabilities(worker_rows.where("status = 'online'")).agg(F.min("caps.optimal_batch_size")).first()[0]
    return best or default


def run(services: DataFrame, job_rows: DataFrame, worker_rows: DataFrame, worker: str, now: Column, settings: OrchestratorSettings = OrchestratorSettings(), make=HashingEncoder) -> EmbeddingRun:
    """Queue, claim and finish jobs; whatever can't be embedded fails and counts a retry.

    ``services`` has id, name, description, taxonomies, url, embedding_v2 and
    embedding_v2_updated_at.
    """
    room = workers.capacity(worker_rows, settings.batch_size).first().take
    stale = jobs.reset_stale(job_rows, settings.stale_minutes, now)
    queued = materialize(stale.unionByName(jobs.queue_new_jobs(services, stale, room, now)), "jobs")
    claimed = materialize(jobs.claim_jobs(queued, worker, room, now), "claimed")
    texts = prepared_texts(services.join(claimed.select(F.col("service_id").alias("id")).distinct(), "id", "left_semi"))
    vectors = materialize(encoder.embed(texts, "id", "text", make, sub_batch(worker_rows)).join(texts.select("id", "tokens"), "id").withColumnRenamed("id", "service_id"), "vectors")
    results = claimed.select(F.col("id").alias("job_id"), "service_id").join(vectors, "service_id")
    done = jobs.apply_events(claimed, jobs.settle_results(claimed, results), now)
    stats = done.agg(F.count("*").alias("items"), F.count(F.when(F.col("status") == "completed", 1)).alias("succeeded"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))
    return EmbeddingRun(merge(queued, done, ["id"]), jobs.store_embeddings(services, vectors, now), stats)
