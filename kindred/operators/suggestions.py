"""Suggestions for reviewers, and what reviewers decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import constants as K
from kindred.sources.io import merge, stable_id

COLUMNS = ["id", "pipeline_run_id", "action_type", "entity_id", "group_id_1", "group_id_2", "cluster_id", "triggering_confidence", "details", "reason_code", "reason_message", "priority", "status"]


def _suggestion(rows: DataFrame, run: str, action: str, code: str, message: Column, confidence: Column, priority: Column, details: Column, **ids: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    ids = {k: ids.get(k, null) for k in ("entity_id", "group_id_1", "group_id_2", "cluster_id")}
    values = {
        "id": stable_id(F.lit(run), F.lit(action), *ids.values()), "pipeline_run_id": F.lit(run), "action_type": F.lit(action), **ids, "triggering_confidence": confidence, "details": details,
        "reason_code": F.lit(code), "reason_message": message, "priority": priority.cast("int"), "status": F.lit("PENDING_REVIEW"),
    }
    return rows.select(*[values[c].cast("string").alias(c) if c in ids else values[c].alias(c) for c in COLUMNS])


def low_confidence(pairs: DataFrame, run: str) -> DataFrame:
    """Pairs below the confidence that needs no review; the least sure first."""
    c = F.col("triggering_confidence")
    return _suggestion(low_pairs(pairs), run, "REVIEW_ENTITY_IN_GROUP", "LOW_TUNED_CONFIDENCE", F.format_string("Pair by %s has confidence %.4f", "method_type", c), c, F.col("priority"), F.to_json(F.struct("entity_id_1", "entity_id_2", "method_type", "match_values")), group_id_1=F.col("id"))


def low_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs of :func:`low_confidence` themselves, with triggering_confidence and priority."""
    c = F.col("confidence_score")
    return pairs.where(c < K.SUGGESTION_CONFIDENCE).withColumn("triggering_confidence", c).withColumn("priority", F.when(c < K.CRITICAL_CONFIDENCE, 2).otherwise(1))


def weak_links(links: DataFrame, run: str) -> DataFrame:
    """Links of pairs with hardly any weight."""
    w = F.col("weight")
    return _suggestion(links.where((w > 0) & (w < K.WEAK_LINK_WEIGHT)), run, "REVIEW_INTER_GROUP_LINK", "WEAK_INTER_GROUP_EDGE", F.format_string("Link has weight %.4f", w), w, F.lit(0), F.to_json(F.struct("shared")), group_id_1=F.col("source_id"), group_id_2=F.col("target_id"))


def split_clusters(scores: DataFrame, run: str) -> DataFrame:
    c = F.col("average_coherence_score")
    return _suggestion(scores.where("suggest_split"), run, "SUGGEST_SPLIT_CLUSTER", "LOW_INTERNAL_CLUSTER_COHERENCE", F.format_string("Cluster has coherence %.4f", c), c, F.lit(1), F.to_json(F.struct("average_coherence_score")), cluster_id=F.col("id"))


def insertable(suggestions: DataFrame) -> DataFrame:
    """Suggestions with an action, none of placeholders."""
    return suggestions.where((F.coalesce(F.col("action_type"), F.lit("")) != "") & ~F.coalesce(F.lower("details").contains("placeholder"), F.lit(False)))


def review(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions after reviews (id, reviewer_id, status, reviewed_at, review_notes); null notes keep the old ones."""
    rest = suggestions.drop("reviewer_id", "status", "reviewed_at").join(decisions.withColumnRenamed("review_notes", "_notes"), "id")
    return merge(suggestions, rest.withColumn("review_notes", F.coalesce("_notes", "review_notes")).select(suggestions.columns), ["id"])


def task_queue(edges: DataFrame, cluster_id: str) -> DataFrame:
    """Links of a cluster to be reviewed, the weakest first, with place and total."""
    from pyspark.sql import Window

    mine = edges.where(F.col("cluster_id") == cluster_id)
    return mine.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy("edge_weight", "entity_id_1", "entity_id_2"))).withColumn("total", F.count("*").over(Window.partitionBy("cluster_id")))


def confirm(edges: DataFrame, decided: DataFrame) -> DataFrame:
    """Edges with ``confirmed`` set for the decided (cluster_id, entity_id_1, entity_id_2)."""
    keys = ["cluster_id", "entity_id_1", "entity_id_2"]
    return edges.join(decided.select(*keys, F.lit(True).alias("confirmed")), keys, "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def reject(edges: DataFrame, decided: DataFrame) -> DataFrame:
    keys = ["cluster_id", "entity_id_1", "entity_id_2"]
    return edges.join(decided.select(keys), keys, "left_anti")


def split_cluster(members: DataFrame, leaving: DataFrame) -> DataFrame:
    """Members (cluster_id, entity_id) after the entities in ``leaving`` have moved to a new cluster of their own."""
    moved = leaving.select("cluster_id", "entity_id").distinct().withColumn("_moved", F.lit(True))
    return members.join(moved, ["cluster_id", "entity_id"], "left").select(F.when(F.col("_moved"), stable_id(F.lit("split"), F.col("cluster_id"))).otherwise(F.col("cluster_id")).alias("cluster_id"), "entity_id")


def evidence(pairs: DataFrame) -> DataFrame:
    """What a pair matched on, for reviewers: both originals and the shared value, by the tag of its values."""
    get = lambda p: F.get_json_object("match_values", f"$.values.{p}")
    kind = F.get_json_object("match_values", "$.type")
    rules = {
        "Email": ("original_email1", "original_email2", "normalized_shared_email"), "Phone": ("original_phone1", "original_phone2", "normalized_shared_phone"), "Url": ("original_url1", "original_url2", "normalized_shared_domain"),
        "Address": ("original_address1", "original_address2", "normalized_shared_address"), "Name": ("original_name1", "original_name2", "pre_rl_match_type"), "Geospatial": ("latitude1", "latitude2", "distance"),
    }

    def pick(i):
        out = None
        for tag, fields in rules.items():
            out = F.when(kind == tag, get(fields[i])) if out is None else out.when(kind == tag, get(fields[i]))
        return out

    return pairs.select("entity_id_1", "entity_id_2", kind.alias("kind"), pick(0).alias("value_1"), pick(1).alias("value_2"), pick(2).alias("shared"))
