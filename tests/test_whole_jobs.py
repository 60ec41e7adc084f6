"""Operators that once left a part of their input out."""

from pyspark.sql import functions as F

from kindred.functions.geo import haversine
from kindred.operators import graph, matchers


def test_communities_keep_weak_links_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "COMPONENT_PAIRS", 5, raising=False)  # the former bound
    k = [(f"{g}{i}", f"{g}{j}", 0.9 if i + j == 7 else 0.5) for g in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 0.1)]
    got = {r.id: r.community for r in graph.communities(spark.createDataFrame(k, "source_id string, target_id string, weight double")).collect()}
    assert got == graph.communities_of(sorted(got), k) and len(got) == 10 and len(set(got.values())) == 2


def test_near_pairs_across_the_date_line_and_at_the_poles(spark):
    lats, lons = (-90.0, -89.999, -85.001, -84.999, 0.0, 40.0, 84.995, 85.004, 89.995, 90.0), (-180.0, -179.9999, -90.0, -0.001, 0.0, 0.002, 89.0, 179.9999, 180.0)
    p = spark.createDataFrame([(10 * i + j, lat, lon) for i, lat in enumerate(lats) for j, lon in enumerate(lons)], "entity_id long, lat double, lon double")
    a, b = p.toDF("i", "a", "b"), p.toDF("j", "p", "q")
    for metres in (2000.0, 200_000.0):
        near = haversine(F.col("a"), F.col("b"), F.col("p"), F.col("q")) <= metres
        want = sorted(map(tuple, a.join(b, (F.col("i") < F.col("j")) & near).select("i", "j").collect()))
        got = sorted(map(tuple, matchers.near_pairs(p, metres).select("entity_id_1", "entity_id_2").collect()))
        assert got == want and len(got) > 50
