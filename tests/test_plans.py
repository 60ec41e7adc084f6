import datetime

import pytest
from pyspark.sql import functions as F

from kindred.operators import stats
from kindred.plans import embedding, steps
from kindred.sources import schemas
from test_pipeline import store

T0 = datetime.datetime(2024, 1, 1)


def test_embedding_run(spark):
    tax = "array<struct<id:string,name:string,description:string>>"
    s = spark.createDataFrame([("s1", "Pantry", "gives food", [("t", "Food", None)], None, None, None), ("s2", "Clinic", None, [], None, None, None), ("s3", "Done", None, [], None, [1.0], None)], f"id string, name string, description string, taxonomies {tax}, url string, embedding_v2 array<float>, embedding_v2_updated_at timestamp")
    w = spark.createDataFrame([("w", "online", '{"max_batch_size": 8, "optimal_batch_size": 2}', 0)], "id string, status string, capabilities string, active_jobs int")
    none = spark.createDataFrame([], schemas.JOBS)
    out = embedding.run(s, none, w, "w", F.lit(T0))
    assert out.stats.first().asDict() == {"items": 2, "succeeded": 2, "failed": 0}
    done = {r.service_id: r for r in out.jobs.collect()}
    assert {r.status for r in done.values()} == {"completed"} and set(done) == {"s1", "s2"} and done["s1"].input_tokens > 0
    assert out.services.where("embedding_v2 is null").count() == 0 and out.services.where("id = 's3'").first().embedding_v2 == [1.0]
    again = embedding.run(out.services, out.jobs, w, "w", F.lit(T0))
    assert again.stats.first().items == 0 and again.jobs.count() == 2


def test_steps(spark):
    t = store(spark)
    new, links = steps.identify_entities(t["organization"], t["entity"], t, t["entity_feature"])
    assert new.count() == 3 and links.count() > 0
    found = steps.match("email", new.join(t["organization"].select(F.col("id").alias("organization_id"), "email"), "organization_id").select(F.col("id").alias("entity_id"), "email"))
    assert found.count() == 1
    pairs = found.withColumn("id", F.lit("p")).withColumn("group_cluster_id", F.lit(None).cast("string"))
    records, placed = steps.consolidate_clusters(pairs)
    assert records.count() == 1 and placed.where("group_cluster_id is null").count() == 0
    with pytest.raises(steps.NothingToDo):
        steps.consolidate_clusters(placed)
    with pytest.raises(steps.NothingToDo):
        steps.match_services(pairs, t["service"], links, t["location"])
    with pytest.raises(KeyError):
        steps.match("fax", pairs)


def test_run_rows(spark):
    row = stats.initial_run(spark, "r")
    out = stats.finished_run(row, {"total_groups": spark.range(7)}, {"matching_time": 2.0, "visualization_time": 9.0}).first()
    assert (out.total_groups, out.total_processing_time, out.total_clusters) == (7, 2.0, 0)
