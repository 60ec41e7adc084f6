"""Work that once grew with the square of the rows where the result doesn't, or met in one task."""

import numpy as np
from plan_rows import most, run, shuffled
from pyspark.sql import functions as F

from kindred.functions import geo, vectors
from kindred.operators import blocking, features, graph, matchers, products


def test_max_cross_similarity_makes_no_row_a_pair_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(products, "NUMBERS", 64 * 20)  # several matrices an entity
    rng = np.random.default_rng(7)
    rows = [(e, [float(x) for x in rng.normal(size=3)]) for e in "abc" for _ in range(100)]
    rows += [("a", [0.0, 0.0, 0.0]), ("d", [0.0, 0.0, 0.0]), ("d", [1.0, None, 2.0]), ("e", []), ("f", None), ("g", [1.0, 2.0]), ("h", [2.0, 1.0]), ("h", [-1.0, -1.0, -1.0])] + [("b", rows[0][1])] * 50
    v = spark.createDataFrame(rows, "entity_id string, embedding array<float>")
    ids = sorted({r[0] for r in rows})
    pairs = spark.createDataFrame([(p, q) for p in ids for q in ids if p < q] + [("a", "z")], "entity_id_1 string, entity_id_2 string")
    a, b = v.toDF("entity_id_1", "x"), v.toDF("entity_id_2", "y")
    best = pairs.join(a, "entity_id_1", "left").join(b, "entity_id_2", "left").groupBy("entity_id_1", "entity_id_2").agg(F.round(F.coalesce(F.max(vectors.cosine(F.col("x"), F.col("y"))), F.lit(0.0)), 6).alias("s"))
    want = sorted(map(tuple, best.select("entity_id_1", "entity_id_2", "s").collect()))
    got, made = run(features.max_cross_similarity(pairs, v))
    assert sorted((r.entity_id_1, r.entity_id_2, round(r.max_service_similarity, 6)) for r in got) == want
    assert 0 < most(made, "Join") < 1000  # 25,000 pairs of vectors


def test_pairs_of_a_block_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(blocking, "PACK", 16)
    rows = [(i, f"https://a.org/{'xyz'[i % 3]}/{i % 7}/{i % 2}/q" if i % 11 else "https://a.org") for i in range(300)]
    rows += [(i, f"https://{h}.org/x/{i % 5}") for i in range(0, 60, 4) for h in "bc"] + [(1000, "https://b.org"), (2000, None)]
    df = spark.createDataFrame(rows, "entity_id long, url string")
    keyed = matchers.url_keys(df).collect()
    want = {}
    for p in keyed:
        for q in keyed:
            if p.entity_id < q.entity_id and p.key == q.key:
                n = next((i for i, (x, y) in enumerate(zip(p.slugs, q.slugs)) if x != y), min(len(p.slugs), len(q.slugs)))
                s = 0.96 if p.slugs == q.slugs else (0.7, 0.8, 0.88, 0.92)[min(n, 3)]
                found = (-s, p.key, n, p.original, q.original)
                want[p.entity_id, q.entity_id] = min(found, want.get((p.entity_id, q.entity_id), found))
    got, most_sent = shuffled(matchers.url_scored(df))
    assert {(r.entity_id_1, r.entity_id_2): (-r.score, r.key, r.slug_count, r.original_1, r.original_2) for r in got} == want and len(got) == len(want) > 44850
    assert 0 < most_sent < 10000


def test_places_meet_once_whatever_entities_are_there(spark, monkeypatch):
    monkeypatch.setattr(blocking, "PACK", 64)
    p = spark.createDataFrame([(i, 40 + (i % 10) / 1000, -100.0) for i in range(600)] + [(5, 40.5, -100.0), (6, 40.5, -100.0)], "entity_id long, lat double, lon double")
    got, made = run(matchers.near_pairs(p, 150.0))  # its own place and both neighbours
    a, b = p.toDF("i", "a", "b"), p.toDF("j", "p", "q")
    want = sorted(map(tuple, a.join(b, (F.col("i") < F.col("j")) & (geo.haversine(F.col("a"), F.col("b"), F.col("p"), F.col("q")) <= 150)).select("i", "j").collect()))
    assert sorted((r.entity_id_1, r.entity_id_2) for r in got) == want and len(want) > 40000
    assert 0 < most(made, "Join") < 5000
    best, sent = shuffled(matchers.match_locations(p, metres=150.0))
    assert sorted((r.entity_id_1, r.entity_id_2) for r in best) == sorted(set(want)) and sent < 5000


def test_features_of_places_make_no_row_a_pair_of_places(spark, monkeypatch):
    monkeypatch.setattr(products, "NUMBERS", 64 * 16)
    rng = np.random.default_rng(5)
    rows = [(e, [float(x) for x in rng.normal(size=1 + k % 2)], 40 + float(rng.integers(300)) / 2000, -100 + float(rng.integers(300)) / 2000) for e in "abc" for k in range(150)]
    rows += [("a", [0.0], 40.0, -100.0), ("b", [1.0, None], 40.0, -100.0), ("d", None, 40.0, -100.0), ("d", [1.0], None, -100.0), ("e", [1.0], 0.0, 0.0), ("a", [], 40.0, -100.0)]
    p = spark.createDataFrame(rows, "entity_id string, embedding array<double>, lat double, lon double")
    pairs = spark.createDataFrame([(x, y) for x in "abcde" for y in "abcdez" if x < y], "entity_id_1 string, entity_id_2 string")
    full = p.where("embedding is not null and lat is not null")
    both = pairs.join(full.toDF("entity_id_1", "u", "a", "b"), "entity_id_1").join(full.toDF("entity_id_2", "v", "p", "q"), "entity_id_2")
    value = vectors.cosine(F.col("u"), F.col("v")) * geo.proximity(geo.haversine(F.col("a"), F.col("b"), F.col("p"), F.col("q")))
    want = {(r[0], r[1]): max(0.0, min(1.0, r[2] or 0.0)) for r in both.groupBy("entity_id_1", "entity_id_2").agg(F.avg(value)).collect()}
    got, made = run(features.service_geo_similarity(pairs, p))
    assert len(got) == 15 and all(abs(r.service_geo_similarity - want.get((r.entity_id_1, r.entity_id_2), 0.0)) < 1e-9 for r in got)
    assert 0 < most(made, "Join") < 1500  # 67,500 pairs of places
    side = p.where("lat is not null")
    d = pairs.join(side.select(F.col("entity_id").alias("entity_id_1"), F.col("lat").alias("a"), F.col("lon").alias("b")), "entity_id_1").join(side.select(F.col("entity_id").alias("entity_id_2"), F.col("lat").alias("p"), F.col("lon").alias("q")), "entity_id_2")
    least = {(r[0], r[1]): max(0.0, 1 - r[2] / 10000) for r in d.groupBy("entity_id_1", "entity_id_2").agg(F.min(geo.haversine(F.col("a"), F.col("b"), F.col("p"), F.col("q")))).collect()}
    got, made = run(features.nearest_proximity(pairs, p))
    assert len(got) == 15 and all(abs(r.geographic_proximity - least.get((r.entity_id_1, r.entity_id_2), 0.0)) < 1e-9 for r in got)
    assert 0 < most(made, "Join") < 1500


def test_totals_of_urls_without_their_pairs(spark):
    rows = [(i, f"https://a.org/{'xyz'[i % 3]}/{i % 7}/{i % 2}/q" if i % 11 else "https://a.org") for i in range(200)]
    rows += [(i, f"https://{h}.org/x/{i % 5}") for i in range(0, 60, 4) for h in "bc"] + [(1000, "https://b.org"), (2000, None), (None, "https://a.org")]
    df = spark.createDataFrame(rows, "entity_id long, url string")
    pairs = matchers.url_scored(df).collect()
    (got,), made = run(matchers.url_totals(df))
    assert (got.n, got.k, got.entities_matched) == (len(pairs), len(pairs), len({e for r in pairs for e in (r.entity_id_1, r.entity_id_2)}))
    assert abs(got.s - sum(r.score for r in pairs)) < 1e-6 and most(made, "Join") < 2000 < len(pairs)
    assert matchers.url_totals(df.where("entity_id = 5")).count() == 0


def test_coherence_sorts_large_clusters_only(spark):
    rows = [(f"{k}-{i}", k, (i % 10) / 10) for k in range(500) for i in range(4)] + [(f"big-{i}", 999, (i % 10) / 10) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, group_cluster_id long, confidence_score double").withColumn("pre_rl_confidence_score", F.lit(None).cast("double"))
    drawn = df.where("group_cluster_id = 999").orderBy(F.xxhash64("id"), "id").limit(20).agg(F.avg("confidence_score")).first()[0]
    got, made = run(graph.coherence_scores(df))
    assert {r.id: round(r.average_coherence_score, 9) for r in got} == {k: 0.15 for k in range(500)} | {999: round(drawn, 9)}
    assert 0 < most(made, "Join") <= 30  # rows that are sorted
