"""Statistics of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def method_stats(pairs: DataFrame) -> DataFrame:
    """For each method: pairs, distinct entities on either side, mean confidence, and the size of a group, which is a pair."""
    # one pass: every pair counts at both its ends, and partial sums by entity are what is shuffled
    ends = pairs.select("method_type", "confidence_score", F.explode(F.array("entity_id_1", "entity_id_2")).alias("e"))
    by_entity = ends.groupBy("method_type", "e").agg(F.count("*").alias("n"), F.count("confidence_score").alias("k"), F.sum("confidence_score").alias("s"))
    by_method = by_entity.groupBy("method_type").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.count("*").alias("entities_matched"))
    return from_totals(by_method.withColumn("n", F.col("n") / 2))


def from_totals(rows: DataFrame) -> DataFrame:
    """:func:`method_stats` from a row a method: pairs ``n``, entities_matched, and the sum ``s`` of ``k`` confidences."""
    mean = F.when(F.col("k") > 0, F.col("s") / F.col("k")).otherwise(0.0)
    return rows.select("method_type", F.col("n").cast("long").alias("groups_created"), "entities_matched", mean.alias("avg_confidence"), F.lit(2.0).alias("avg_group_size"))


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """One row: clusters, mean and largest sizes, clusters of one pair and of more; no row if there are no clusters."""
    return clusters.agg(
        F.count("*").alias("total_clusters"), F.avg("entity_count").alias("avg_entities_per_cluster"), F.avg("group_count").alias("avg_groups_per_cluster"), F.max("entity_count").alias("largest_cluster_size"),
        F.sum(F.when(F.col("group_count") == 1, 1).otherwise(0)).alias("single_group_clusters"), F.sum(F.when(F.col("group_count") > 1, 1).otherwise(0)).alias("multi_group_clusters"),
    ).where("total_clusters > 0")


def service_stats(matches: DataFrame) -> DataFrame:
    """One row: matches, mean similarity, high (over 0.8), medium (0.6 to 0.8) and low ones, clusters with matches."""
    s = F.col("similarity_score")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return matches.agg(F.count("*").alias("total_matches"), F.avg(s).alias("avg_similarity"), F.coalesce(n(s > 0.8), F.lit(0)).alias("high_similarity_matches"), F.coalesce(n(s.between(0.6, 0.8)), F.lit(0)).alias("medium_similarity_matches"), F.coalesce(n(s < 0.6), F.lit(0)).alias("low_similarity_matches"), F.count_distinct("group_cluster_id").alias("clusters_with_matches"))


def run_stats(runs: DataFrame) -> DataFrame:
    """Totals over runs (items, succeeded, failed, seconds): success rate and mean time, 0 where nothing ran."""
    return runs.agg(F.count("*").alias("runs"), F.sum("items").alias("items"), F.sum("succeeded").alias("succeeded"), F.sum("failed").alias("failed"), F.avg("seconds").alias("avg_seconds")).select(
        "runs", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("succeeded", F.lit(0)).alias("succeeded"), F.coalesce("failed", F.lit(0)).alias("failed"),
        F.when(F.col("items") > 0, F.col("succeeded") / F.col("items")).otherwise(0.0).alias("success_rate"), F.coalesce("avg_seconds", F.lit(0.0)).alias("avg_seconds"),
    )


def report(methods: list, cluster: dict | None, service: dict | None, seconds: dict[str, float]) -> str:
    """A run's statistics as text."""
    lines = ["Run report", *(f"  {k}: {v:.1f} s" for k, v in seconds.items()), f"  total: {sum(v for k, v in seconds.items() if k != 'visualization'):.1f} s"]
    lines += [f"  {m['method_type']}: {m['groups_created']} pairs of {m['entities_matched']} entities, mean confidence {m['avg_confidence']:.3f}" for m in methods]
    if cluster:
        lines.append(f"  {cluster['total_clusters']} clusters, {cluster['avg_entities_per_cluster']:.2f} entities on average, {cluster['largest_cluster_size']} at most")
    if service:
        lines.append(f"  {service['total_matches']} service matches, mean similarity {service['avg_similarity'] or 0:.3f}")
    return "\n".join(lines)


def initial_run(spark, run: str, description: str = "") -> DataFrame:
    """A run's row before anything is known; merging the finished one by id replaces it."""
    totals = ("total_entities", "total_groups", "total_clusters", "total_service_matches", "total_visualization_edges")
    times = ("entity_processing_time", "context_feature_time", "matching_time", "clustering_time", "visualization_time", "service_matching_time", "total_processing_time")
    return spark.range(1).select(F.lit(run).alias("id"), F.lit(description).alias("description"), *[F.lit(0).cast("long").alias(x) for x in totals], *[F.lit(0.0).alias(x) for x in times])


def finished_run(row: DataFrame, totals: dict[str, DataFrame], seconds: dict[str, float]) -> DataFrame:
    """The run's row with the counts of its tables and the time of its phases; the total leaves visualization out."""
    out = row
    for name, rows in totals.items():
        out = out.drop(name).crossJoin(rows.agg(F.count("*").alias(name)))  # one row each
    for name, value in seconds.items():
        out = out.withColumn(name, F.lit(float(value)))
    out = out.withColumn("total_processing_time", F.lit(float(sum(v for k, v in seconds.items() if k not in ("visualization_time", "total_processing_time")))))
    return out.select(row.columns)


def lowest_coherence(clusters: DataFrame, n: int = 10) -> DataFrame:
    """The clusters that most need a look."""
    return clusters.where("average_coherence_score is not null").orderBy("average_coherence_score", "id").limit(n)
