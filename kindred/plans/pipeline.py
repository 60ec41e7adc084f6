"""The whole matching run: entities, features, matchers, clusters, edges, services."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import bandit, entities, graph, matchers, services, stats, suggestions
from kindred.sources.io import new_rows, stable_id
from kindred.sources.storage import materialize

PAIR_KEYS = ["entity_id_1", "entity_id_2", "method_type"]


@dataclass
class Run:
    """What a run adds to the store."""

    entities: DataFrame
    features: DataFrame
    pairs: DataFrame
    clusters: DataFrame
    edges: DataFrame
    service_matches: DataFrame
    suggestions: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


def all_matches(found: DataFrame, tables: dict[str, DataFrame], existing: DataFrame, arms: DataFrame | None, run: str = "", explore: float = bandit.EPSILON) -> DataFrame:
    """New pairs of all matchers. ``found``: entities (id, organization_id, name) with records in ``tables['entity_feature']``."""
    f = tables["entity_feature"]
    org = found.select(F.col("id").alias("entity_id"), F.col("organization_id")).join(tables["organization"].select(F.col("id").alias("organization_id"), "name", "email", "url", "embedding"), "organization_id")
    service = entities.feature_rows(f, tables["service"], "service")
    place = entities.feature_rows(f, tables["location"], "location")
    tune = (lambda p: bandit.tune(p, arms, explore, run)) if arms is not None else None
    parts = [
        matchers.match_emails(org.select("entity_id", "email").union(service.select("entity_id", "email")), existing, tune),
        matchers.match_phones(entities.feature_rows(f, tables["phone"], "phone"), existing, tune),
        matchers.match_urls(org.select("entity_id", "url").union(service.select("entity_id", "url")), existing, tune),
        matchers.match_addresses(place.select("entity_id", F.col("id").alias("location_id")).join(tables["address"], "location_id"), existing, tune),
        matchers.match_names(org.select("entity_id", "name"), org.select("entity_id", "embedding"), existing, tune),
        matchers.match_locations(place.select("entity_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), existing, tune),
    ]
    return reduce(DataFrame.unionByName, parts).select(stable_id(*map(F.col, PAIR_KEYS)).alias("id"), *matchers.RESULT)


def run(tables: dict[str, DataFrame], name: str, arms: DataFrame | None = None, explore: float = bandit.EPSILON) -> Run:
    """One run over the tables; running again with its results stored adds nothing.

    With ``arms``, a share ``explore`` of the pairs tries an arm other than the best.
    """
    new_entities = materialize(entities.extract_entities(tables["organization"], tables["entity"]), "entities")
    every = tables["entity"].select("id", "organization_id", "name").unionByName(new_entities)
    links = materialize(entities.link_entity_features(every, tables, tables["entity_feature"]), "links")
    tables = tables | {"entity_feature": tables["entity_feature"].select("id", "entity_id", "table_name", "table_id").unionByName(links)}
    old = tables["entity_group"]
    pairs = materialize(new_rows(all_matches(every, tables, old, arms, name, explore), old, PAIR_KEYS).withColumn("group_cluster_id", F.lit(None).cast("string")), "pairs")
    graph_links = materialize(graph.pair_graph(pairs), "graph")
    found = materialize(graph.communities(graph_links), "communities")
    records = graph.clusters(pairs, found)
    placed = materialize(graph.assign_clusters(pairs, found, records), "placed")
    scores = graph.coherence_scores(placed)
    clusters = materialize(records.join(scores, "id", "left"), "clusters")
    weight = bandit.reviewer_weight(tables["human_review"])
    edges = graph.visualization_edges(placed, weight, name)
    mine = services.cluster_services(placed, tables["service"].select("id", F.col("embedding_v2").alias("embedding")), tables["entity_feature"])
    at = tables["service_at_location"].join(tables["location"].select(F.col("id").alias("location_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), "location_id").select("service_id", "lat", "lon")
    matches = services.match_services(mine, at, tables["service_match"])
    todo = reduce(DataFrame.unionByName, [suggestions.low_confidence(placed, name), suggestions.weak_links(graph_links, name), suggestions.split_clusters(scores, name)])
    return Run(new_entities, links, placed, clusters, edges, matches, suggestions.insertable(todo))


def summary(result: Run) -> str:
    one = lambda df: (df.first() or None)
    as_dict = lambda r: r.asDict() if r else None
    return stats.report([r.asDict() for r in stats.method_stats(result.pairs).orderBy("method_type").collect()], as_dict(one(stats.cluster_stats(result.clusters))), as_dict(one(stats.service_stats(result.service_matches))), result.seconds)
