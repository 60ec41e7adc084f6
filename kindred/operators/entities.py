"""Entities of organisations, and the records that belong to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.io import stable_id

FEATURE_TABLES = ("service", "phone", "location", "contact")


def extract_entities(organizations: DataFrame, entities: DataFrame) -> DataFrame:
    """New entities (id, organization_id, name): one for each organisation that has none."""
    return organizations.join(entities.select(F.col("organization_id").alias("id")).distinct(), "id", "left_anti").select(stable_id(F.lit("entity"), F.col("id")).alias("id"), F.col("id").alias("organization_id"), "name")


def phone_routes(tables: dict[str, DataFrame]) -> DataFrame:
    """Phones and their organisations (phone_id, organization_id), by the first of five routes that applies.

    A phone names its organisation, or a service, or a service at a location
    (whose service or, failing that, location names it), or a contact. Later
    routes count only where earlier columns are null.
    """
    phone, service, sal, location, contact = (tables[t] for t in ("phone", "service", "service_at_location", "location", "contact"))
    no = lambda *cs: reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cs])
    org = lambda t: t.where("organization_id is not null").select(F.col("id").alias("_id"), "organization_id")
    p = phone.select(F.col("id").alias("phone_id"), "organization_id", "service_id", "service_at_location_id", "contact_id")
    direct = p.where("organization_id is not null").select("phone_id", "organization_id")
    by_service = p.where(no("organization_id")).drop("organization_id").join(org(service), F.col("service_id") == F.col("_id")).select("phone_id", "organization_id")
    at = p.where(no("organization_id", "service_id")).select("phone_id", "service_at_location_id").join(sal.select(F.col("id").alias("service_at_location_id"), "service_id", "location_id"), "service_at_location_id")
    by_sal = at.join(org(service), F.col("service_id") == F.col("_id")).select("phone_id", "organization_id")
    by_place = at.join(org(location), F.col("location_id") == F.col("_id")).select("phone_id", "organization_id").join(by_sal.select("phone_id").distinct(), "phone_id", "left_anti")
    by_contact = p.where(no("organization_id", "service_id", "service_at_location_id")).drop("organization_id").join(org(contact), F.col("contact_id") == F.col("_id")).select("phone_id", "organization_id")
    return reduce(DataFrame.unionByName, [direct, by_service, by_sal, by_place, by_contact]).distinct()


def entity_features(entities: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """All records of every entity: entity_id, table_name, table_id."""
    owner = entities.select(F.col("id").alias("entity_id"), "organization_id")
    own = lambda t: tables[t].where("organization_id is not null").select("organization_id", F.lit(t).alias("table_name"), F.col("id").alias("table_id"))
    placed = tables["service_at_location"].join(tables["service"].select(F.col("id").alias("service_id"), "organization_id"), "service_id").where("organization_id is not null").select("organization_id", F.lit("location").alias("table_name"), F.col("location_id").alias("table_id"))
    phones = phone_routes(tables).select("organization_id", F.lit("phone").alias("table_name"), F.col("phone_id").alias("table_id"))
    rows = reduce(DataFrame.unionByName, [own("service"), phones, own("location"), placed, own("contact")])
    return owner.join(rows, "organization_id").select("entity_id", "table_name", "table_id").distinct()


def link_entity_features(entities: DataFrame, tables: dict[str, DataFrame], existing: DataFrame) -> DataFrame:
    """New rows for ``entity_feature``; a second run over the same data has none."""
    keys = ["entity_id", "table_name", "table_id"]
    new = entity_features(entities, tables).join(existing.select(keys).distinct(), keys, "left_anti")
    return new.select(stable_id(*map(F.col, keys)).alias("id"), *keys)


def feature_rows(features: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Records of one table with the entity that they belong to."""
    mine = features.where(F.col("table_name") == name).select("entity_id", F.col("table_id").alias("id"))
    return mine.join(table, "id")


def nest_taxonomies(services: DataFrame, links: DataFrame, terms: DataFrame) -> DataFrame:
    """Services with an array of their categories (id, name, description); empty where there are none."""
    t = links.join(terms.select(F.col("id").alias("taxonomy_term_id"), F.col("term").alias("name"), "description"), "taxonomy_term_id")
    nested = t.groupBy(F.col("service_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("taxonomy_term_id").alias("id"), "name", "description"))).alias("taxonomies"))
    empty = F.array().cast("array<struct<id:string,name:string,description:string>>")
    return services.join(nested, "id", "left").withColumn("taxonomies", F.coalesce("taxonomies", empty))


def entity_card(entities: DataFrame, features: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row an entity with its records nested by table."""
    out = entities.select(F.col("id").alias("entity_id"), "organization_id", F.coalesce("name", F.concat(F.lit("Entity "), F.substring("id", 1, 8))).alias("name"))
    for t in FEATURE_TABLES:
        rows = feature_rows(features, tables[t], t)
        nested = rows.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "entity_id"]))).alias(f"{t}s"))
        out = out.join(nested, "entity_id", "left")
    return out
