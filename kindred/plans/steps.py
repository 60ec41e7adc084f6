"""The phases of a run as single steps, with the same refusals as the whole run's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import entities, features, graph, matchers, services

MATCHERS = {
    "email": matchers.match_emails,
    "phone": matchers.match_phones,
    "url": matchers.match_urls,
    "address": matchers.match_addresses,
    "name": matchers.match_names,
    "geospatial": matchers.match_locations,
}


class NothingToDo(ValueError):
    """A step's input has no rows that it could work on."""


def _require(rows: DataFrame, what: str) -> DataFrame:
    if not rows.limit(1).count():
        raise NothingToDo(f"there are no {what}")
    return rows


def identify_entities(organizations: DataFrame, known: DataFrame, tables: dict[str, DataFrame], linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New entities, and new links of all entities to their records."""
    new = entities.extract_entities(organizations, known)
    return new, entities.link_entity_features(known.select("id", "organization_id", "name").unionByName(new), tables, linked)


def extract_context_features(organizations: DataFrame, links: DataFrame, service_vectors: DataFrame) -> DataFrame:
    """Feature rows of all entities, ready to be merged into the stored ones."""
    return features.stored_features(features.entity_feature_vectors(_require(organizations, "entities"), links, service_vectors))


def match(method: str, rows: DataFrame, existing: DataFrame | None = None, **more) -> DataFrame:
    """New pairs of one method."""
    if method not in MATCHERS:
        raise KeyError(f"unknown method: {method}")
    return MATCHERS[method](rows, existing=existing, **more)


def consolidate_clusters(pairs: DataFrame, method: str = "leiden") -> tuple[DataFrame, DataFrame]:
    """Cluster records of the pairs that have none, and these pairs with their cluster."""
    open_pairs = _require(pairs.where("group_cluster_id is null"), "pairs without a cluster")
    found = graph.communities(graph.pair_graph(open_pairs), method)
    records = graph.clusters(open_pairs, found)
    return records, graph.assign_clusters(open_pairs, found, records)


def match_services(pairs: DataFrame, service_rows: DataFrame, links: DataFrame, places: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New service matches inside the clusters of ``pairs``."""
    _require(pairs.where(F.col("group_cluster_id").isNotNull()), "clusters")
    return services.match_services(services.cluster_services(pairs, service_rows, links), places, existing)
