"""Context features of entities (12) and of pairs (7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import contact, geo, urls
from kindred.functions.similarity import trigram_similarity
from kindred.functions.vectors import cosine, cosine_distance
from kindred.operators.products import compare_entities, largest_cosine, near_sums, nearest
from kindred.sources.io import stable_id

ENTITY_FEATURES = (
    "name_complexity", "data_completeness", "has_email", "has_phone", "has_url", "has_address", "has_location", "organization_size",
    "service_count", "embedding_centroid_distance", "service_semantic_coherence", "embedding_quality",
)
PAIR_FEATURES = ("name_similarity", "embedding_similarity", "max_service_similarity", "geographic_proximity", "shared_domain", "shared_phone", "service_geo_similarity")
UPPER = {"embedding_centroid_distance": 2.0}


def feature_catalog(spark: SparkSession) -> DataFrame:
    """Every feature with its bounds: name, scope, least, most."""
    rows = [(f, "entity", 0.0, UPPER.get(f, 1.0)) for f in ENTITY_FEATURES] + [(f, "pair", 0.0, 1.0) for f in PAIR_FEATURES]
    return spark.createDataFrame(rows, "name string, scope string, least double, most double")


def name_complexity(name: Column) -> Column:
    """Half by bytes (100 are most), half by words (10 are most)."""
    words = F.size(F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.least(F.octet_length(F.coalesce(name, F.lit(""))) / 100, F.lit(1.0)) * 0.5 + F.least(words / 10, F.lit(1.0)) * 0.5


def data_completeness(name: Column, description: Column, email: Column, url: Column, tax_id: Column, legal_status: Column) -> Column:
    """Share of six values that are given; a description counts from six characters on."""
    given = [F.coalesce(c != "", F.lit(False)).cast("int") for c in (name, email, url, tax_id, legal_status)]
    return (sum(given[1:], given[0]) + F.coalesce(F.length(description) > 5, F.lit(False)).cast("int")) / 6


def organization_size(services: Column, locations: Column, has_phone: Column) -> Column:
    return 0.5 * F.least(services / 10, F.lit(1.0)) + 0.3 * F.least(locations / 5, F.lit(1.0)) + 0.2 * has_phone


def embedding_quality(embedding: Column, description: Column) -> Column:
    size = F.length(description)
    return F.when(embedding.isNull(), 0.0).when(description.isNull() | (size == 0), 0.1).when(size < 20, 0.3).when(size < 100, 0.6).otherwise(0.9)


def vector_mean(rows: DataFrame, vector: str, keys: list[str] | None = None) -> DataFrame:
    """Mean vector (of each key): places are averaged apart, so partial sums are combined before the shuffle."""
    keys = keys or []
    at = rows.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("_i", "_x"))
    means = at.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))


def coherence(vectors: DataFrame, key: str, item: str, vector: str) -> DataFrame:
    """Mean cosine of all pairs of a key's vectors (0 below two), without making the pairs.

    The sum over pairs follows from the length of the sum of unit vectors.
    Zero vectors have cosine 0 with everything.
    """
    from kindred.functions.vectors import unit

    units = vectors.where(F.col(vector).isNotNull()).select(key, item, unit(F.col(vector)).alias("_u"))
    counts = units.groupBy(key).agg(F.count("*").alias("_n"), F.sum(F.when(F.exists("_u", lambda x: x != 0), 1).otherwise(0)).alias("_k"))
    sums = units.select(key, F.posexplode("_u").alias("_i", "_x")).groupBy(key, "_i").agg(F.sum("_x").alias("_s")).groupBy(key).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    n = F.col("_n")
    return counts.join(sums, key).select(key, F.when(n > 1, (F.col("_q") - F.col("_k")) / (n * (n - 1))).otherwise(0.0).alias("service_semantic_coherence"))


def entity_feature_vectors(organizations: DataFrame, features: DataFrame, service_vectors: DataFrame) -> DataFrame:
    """The 12 features of every entity.

    ``organizations``: entity_id, name, description, email, url, tax_id,
    legal_status, embedding. ``features``: entity_id, table_name, table_id.
    ``service_vectors``: entity_id, service_id, embedding.
    """
    c = F.col
    has = lambda t: F.max(F.when(c("table_name") == t, 1).otherwise(0))
    count = lambda t: F.sum(F.when(c("table_name") == t, 1).otherwise(0))
    counts = features.groupBy("entity_id").agg(count("service").alias("_services"), count("location").alias("_locations"), has("phone").alias("_phone"), has("location").alias("_location"), has("address").alias("_address"))
    center = vector_mean(organizations, "embedding")
    o = organizations.join(counts, "entity_id", "left").crossJoin(F.broadcast(center))  # the centre is one row
    o = o.join(coherence(service_vectors, "entity_id", "service_id", "embedding"), "entity_id", "left").fillna(0, ["_services", "_locations", "_phone", "_location", "_address"]).fillna(0.0, ["service_semantic_coherence"])
    flag = lambda x: x.cast("double")
    return o.select(
        "entity_id",
        name_complexity(c("name")).alias("name_complexity"),
        data_completeness(c("name"), c("description"), c("email"), c("url"), c("tax_id"), c("legal_status")).alias("data_completeness"),
        flag(c("email").isNotNull()).alias("has_email"),
        flag(c("_phone")).alias("has_phone"),
        flag(c("url").isNotNull()).alias("has_url"),
        flag(F.greatest("_address", "_location")).alias("has_address"),
        flag(c("_location")).alias("has_location"),
        organization_size(c("_services"), c("_locations"), c("_phone")).alias("organization_size"),
        F.least(c("_services") / 10, F.lit(1.0)).alias("service_count"),
        cosine_distance(c("embedding"), c("centroid")).alias("embedding_centroid_distance"),
        "service_semantic_coherence",
        embedding_quality(c("embedding"), c("description")).alias("embedding_quality"),
    )


def stored_features(vectors: DataFrame) -> DataFrame:
    """Feature rows (id, entity_id, feature_name, feature_value) as they are stored."""
    rows = vectors.select("entity_id", F.explode(F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("feature_value")) for f in ENTITY_FEATURES])).alias("f")).select("entity_id", "f.*")
    return rows.select(stable_id(F.col("entity_id"), F.col("feature_name")).alias("id"), "entity_id", "feature_name", "feature_value")


def read_stored(stored: DataFrame) -> DataFrame:
    """Entities that have all twelve features stored, one row each."""
    rows = stored.where(F.col("feature_name").isin(*ENTITY_FEATURES))
    whole = rows.groupBy("entity_id").pivot("feature_name", list(ENTITY_FEATURES)).agg(F.max("feature_value"))
    return whole.dropna()


def cached_or_computed(stored: DataFrame, compute, entities: DataFrame) -> DataFrame:
    """Stored features where complete; ``compute(missing)`` gives those of the other entities."""
    have = read_stored(stored)
    missing = entities.select("entity_id").join(have.select("entity_id"), "entity_id", "left_anti")
    return have.unionByName(compute(missing).select("entity_id", *ENTITY_FEATURES))


def _known(vector: str, rows: DataFrame) -> Column:
    """The vector, or zeros in its place if a number is missing: its cosine is 0 then."""
    zero = F.lit(0).cast(rows.schema[vector].dataType.elementType)
    return F.when(F.exists(vector, lambda x: x.isNull()), F.transform(vector, lambda x: zero)).otherwise(F.col(vector))


def max_cross_similarity(pairs: DataFrame, service_vectors: DataFrame) -> DataFrame:
    """Largest cosine between the services of both entities; 0 where a side has none."""
    rows = service_vectors.where("embedding is not null").select("entity_id", _known("embedding", service_vectors).alias("x")).distinct()
    found = compare_entities(pairs, rows, largest_cosine, "best double")
    best = found.groupBy("entity_id_1", "entity_id_2").agg(F.max("best").alias("max_service_similarity"))
    return pairs.select("entity_id_1", "entity_id_2").join(best, ["entity_id_1", "entity_id_2"], "left").fillna(0.0, ["max_service_similarity"])


def _service_pairs(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    side = lambda i: rows.select(F.col("entity_id").alias(f"entity_id_{i}"), *[F.col(x).alias(f"{x}_{i}") for x in columns])
    return pairs.select("entity_id_1", "entity_id_2").join(side(1), "entity_id_1").join(side(2), "entity_id_2")


def nearest_proximity(pairs: DataFrame, locations: DataFrame, limit: float = geo.PROXIMITY_METRES) -> DataFrame:
    """Proximity by the smallest distance between both entities' locations; 0 where a side has none."""
    places = locations.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").select("entity_id", F.array(F.col("lat").cast("double"), F.col("lon").cast("double")).alias("x")).distinct()
    near = compare_entities(pairs, places, nearest(limit), "d double").groupBy("entity_id_1", "entity_id_2").agg(F.min("d").alias("_d"))
    return pairs.select("entity_id_1", "entity_id_2").join(near, ["entity_id_1", "entity_id_2"], "left").select("entity_id_1", "entity_id_2", F.coalesce(geo.proximity(F.col("_d"), limit), F.lit(0.0)).alias("geographic_proximity"))


def service_geo_similarity(pairs: DataFrame, places: DataFrame, limit: float = geo.PROXIMITY_METRES) -> DataFrame:
    """Mean of similarity times proximity over all service locations of both entities, within 0 and 1.

    ``places``: entity_id, embedding, lat, lon. Unit vectors at one place are
    added up first: the sum of cosines of two places is one dot product.
    """
    from kindred.functions.vectors import unit

    rows = places.where("embedding is not null and lat is not null and lon is not null")
    site = ["entity_id", "_w", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")]
    at = rows.withColumn("_u", unit(_known("embedding", places))).withColumn("_w", F.size("_u")).select(*site, F.posexplode("_u").alias("_i", "_x"))
    sums = at.groupBy("entity_id", "_w", "lat", "lon", "_i").agg(F.sum("_x").alias("_s"), F.count("*").cast("double").alias("_n"))
    whole = sums.groupBy("entity_id", "_w", "lat", "lon").agg(F.max("_n").alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda s: s["_s"]).alias("_v"))
    both = compare_entities(pairs, whole.select("entity_id", F.concat(F.array("lat", "lon", "_n"), "_v").alias("x")), near_sums(limit), "total double, n double")
    mean = both.groupBy("entity_id_1", "entity_id_2").agg((F.sum("total") / F.sum("n")).alias("_m"))
    return pairs.select("entity_id_1", "entity_id_2").join(mean, ["entity_id_1", "entity_id_2"], "left").select("entity_id_1", "entity_id_2", F.greatest(F.least(F.coalesce("_m", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("service_geo_similarity"))


def shared_phone(pairs: DataFrame, phones: DataFrame) -> DataFrame:
    """1 where both entities have a number of the same digits."""
    rows = phones.select("entity_id", contact.digits(F.col("number")).alias("digits")).where("digits != ''").distinct()
    hit = _service_pairs(pairs, rows, ["digits"]).where("digits_1 = digits_2").select("entity_id_1", "entity_id_2").distinct().withColumn("shared_phone", F.lit(1.0))
    return pairs.select("entity_id_1", "entity_id_2").join(hit, ["entity_id_1", "entity_id_2"], "left").fillna(0.0, ["shared_phone"])


def pair_feature_values(pairs: DataFrame, organizations: DataFrame, service_vectors: DataFrame, locations: DataFrame, phones: DataFrame, places: DataFrame) -> DataFrame:
    """The seven features of every pair; whatever can't be known is 0."""
    keys = ["entity_id_1", "entity_id_2"]
    o = pairs.select(*keys)
    for i in "12":
        o = o.join(organizations.select(*[F.col(x).alias(f"{x}_{i}") for x in ("entity_id", "name", "url", "embedding")]), f"entity_id_{i}", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = o.select(
        *keys,
        zero(trigram_similarity(F.lower("name_1"), F.lower("name_2"))).alias("name_similarity"),
        zero(cosine(F.col("embedding_1"), F.col("embedding_2"))).alias("embedding_similarity"),
        zero(((urls.bare_domain(F.col("url_1")) == urls.bare_domain(F.col("url_2"))) & (urls.bare_domain(F.col("url_1")) != "")).cast("double")).alias("shared_domain"),
    )
    for part in (max_cross_similarity(pairs, service_vectors), nearest_proximity(pairs, locations), shared_phone(pairs, phones), service_geo_similarity(pairs, places)):
        out = out.join(part, keys)
    return out.select(*keys, *PAIR_FEATURES)


def pair_contexts(pairs: DataFrame, entity_vectors: DataFrame, pair_values: DataFrame) -> DataFrame:
    """The 31 numbers of a pair: twelve of each entity, then seven of the pair."""
    keys = ["entity_id_1", "entity_id_2"]
    packed = entity_vectors.select("entity_id", F.array(*[F.col(f).cast("double") for f in ENTITY_FEATURES]).alias("v"))
    out = pairs.select(*keys)
    for i in "12":
        out = out.join(packed.select(F.col("entity_id").alias(f"entity_id_{i}"), F.col("v").alias(f"v_{i}")), f"entity_id_{i}")
    return out.join(pair_values, keys).select(*keys, F.concat("v_1", "v_2", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in PAIR_FEATURES])).alias("features"))
