"""Services of a cluster that are the same service."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import constants as K
from kindred.functions import geo
from kindred.operators.blocking import both_sides
from kindred.sources.io import stable_id

#: Rows of one side of a product of vectors.
BLOCK_ROWS = 1024


def cluster_services(pairs: DataFrame, services: DataFrame, features: DataFrame) -> DataFrame:
    """Services of each cluster's entities (cluster_id, service_id, embedding); without a vector they can't match."""
    members = both_sides(pairs.where("group_cluster_id is not null"), "group_cluster_id").distinct()
    mine = features.where("table_name = 'service'").select("entity_id", F.col("table_id").alias("service_id"))
    return members.join(mine, "entity_id").join(services.where("embedding is not null").select(F.col("id").alias("service_id"), "embedding"), "service_id").select(F.col("group_cluster_id").alias("cluster_id"), "service_id", "embedding").dropDuplicates(["cluster_id", "service_id"])


def similar_within(rows: DataFrame, key: str, item: str, vector: str, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of a key's items whose vectors have at least ``threshold`` cosine: key, item_1 < item_2, similarity.

    A key's rows are cut into blocks of bounded size by a hash; every two
    blocks are one product of matrices in a task of its own. Zero vectors match
    nothing.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    dealt = rows.join(sizes, key).withColumn("_b", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least("_b", o).alias("i"), F.greatest("_b", o).alias("j")))
    tasks = dealt.select(key, item, F.col(vector).cast("array<double>").alias("_v"), "_b", F.explode(meets).alias("_t")).select(key, item, "_v", "_b", "_t.i", "_t.j")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = {key: [], f"{item}_1": [], f"{item}_2": [], "similarity": []}
        for _, same in frame.groupby(frame["_v"].map(len)):
            x = np.stack(same["_v"].to_numpy())
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
            left = np.flatnonzero(same["_b"].to_numpy() == same["i"].iloc[0])
            right = np.flatnonzero(same["_b"].to_numpy() == same["j"].iloc[0])
            items = same[item].to_numpy()
            sims = x[left] @ x[right].T
            for a, b in zip(*np.nonzero(sims >= threshold)):
                p, q = items[left[a]], items[right[b]]
                if p < q or (p != q and same["i"].iloc[0] != same["j"].iloc[0]):
                    for c, v in zip(out, (same[key].iloc[0], min(p, q), max(p, q), float(sims[a, b]))):
                        out[c].append(v)
        return pd.DataFrame(out, dtype=object)

    return tasks.groupBy(key, "i", "j").applyInPandas(compare, f"{key} {kinds[key]}, {item}_1 {kinds[item]}, {item}_2 {kinds[item]}, similarity double")


def near_services(pairs: DataFrame, places: DataFrame, metres: float = K.SERVICE_METRES) -> DataFrame:
    """For pairs (service_id_1, service_id_2): whether both have locations, and whether any two are near.

    ``places``: service_id, lat, lon.
    """
    known = places.where("lat is not null and lon is not null").distinct()
    keys = ["service_id_1", "service_id_2"]
    side = lambda i: known.select(F.col("service_id").alias(f"service_id_{i}"), F.col("lat").alias(f"lat_{i}"), F.col("lon").alias(f"lon_{i}"))
    d = geo.haversine(F.col("lat_1"), F.col("lon_1"), F.col("lat_2"), F.col("lon_2"))
    met = pairs.select(keys).distinct().join(side(1), "service_id_1").join(side(2), "service_id_2").groupBy(*keys).agg(F.max(d <= metres).alias("near"))
    return pairs.join(met, keys, "left").withColumn("both_located", F.col("near").isNotNull()).withColumn("near", F.coalesce("near", F.lit(False)))


def match_services(services: DataFrame, places: DataFrame, existing: DataFrame | None = None, similarity: float = K.SERVICE_SIMILARITY, metres: float = K.SERVICE_METRES) -> DataFrame:
    """Matches of services (cluster_id, service_id, embedding) within a cluster.

    Services must be similar; where both have locations, two of these must also
    be near. Pairs matched before, in either order and any cluster, are left out.
    """
    found = near_services(similar_within(services, "cluster_id", "service_id", "embedding", similarity), places, metres).where("near or not both_located")
    if existing is not None:
        old = existing.select(F.least("service_id_1", "service_id_2").alias("service_id_1"), F.greatest("service_id_1", "service_id_2").alias("service_id_2")).distinct()
        found = found.join(old, ["service_id_1", "service_id_2"], "left_anti")
    reason = F.when(F.col("both_located"), "semantic and geospatial").otherwise("semantic")
    return found.select(
        stable_id(F.lit("service_match"), F.col("cluster_id"), F.col("service_id_1"), F.col("service_id_2")).alias("id"), F.col("cluster_id").alias("group_cluster_id"), "service_id_1", "service_id_2",
        F.col("similarity").alias("similarity_score"), F.to_json(F.struct(reason.alias("reason"))).alias("match_reasons"), F.lit("potential").alias("status"),
    )
