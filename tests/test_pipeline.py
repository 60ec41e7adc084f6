from pyspark.sql import functions as F

from kindred.operators import bandit
from kindred.plans import pipeline
from kindred.sources import schemas


def store(spark):
    mk = lambda rows, schema: spark.createDataFrame(rows, schema)
    org = [("o1", "Food Bank of Kent", "gives food", "a@kent.org", "https://kent.org/food", None, None, None, None), ("o2", "Food Bank of Kent Inc", None, "A+x@kent.org", "http://www.kent.org/food", None, None, None, None), ("o3", "Other House", None, None, None, None, None, None, None)]
    service = [(s, o, "Pantry", None, None, None, None, "active", v, None) for s, o, v in (("s1", "o1", [1.0, 0.0]), ("s2", "o2", [1.0, 0.01]), ("s3", "o3", [0.0, 1.0]))]
    empty = lambda s: mk([], s)
    return {
        "organization": mk(org, schemas.ORGANIZATION), "service": mk(service, schemas.SERVICE), "phone": mk([("p1", "206 555 0100", None, "o1", None, None, None), ("p2", "+1 206-555-0100", None, None, "s2", None, None)], schemas.PHONE),
        "location": mk([("l1", "o1", 47.0, -122.0), ("l3", "o3", 47.0001, -122.0)], schemas.LOCATION), "address": mk([("l1", "1 Main St", None, "Kent", "WA", "98030", "US")], schemas.ADDRESS),
        "service_at_location": empty(schemas.SERVICE_AT_LOCATION), "contact": empty(schemas.CONTACT), "entity": empty(schemas.ENTITY), "entity_feature": empty(schemas.ENTITY_FEATURE), "entity_group": empty(schemas.ENTITY_GROUP),
        "service_match": empty(schemas.SERVICE_MATCH), "human_review": mk([("a", True)], "reviewer_id string, was_correct boolean"),
    }


def test_run_and_rerun(spark):
    tables = store(spark)
    first = pipeline.run(tables, "r1", bandit.default_arms(spark))
    assert first.entities.count() == 3
    found = {r.method_type for r in first.pairs.collect()}
    assert {"email", "phone", "url", "geospatial"} <= found
    assert first.clusters.count() >= 1 and first.edges.count() >= 1
    assert [(r.service_id_1, r.service_id_2) for r in first.service_matches.collect()] == [("s1", "s2")]
    assert "pairs" in pipeline.summary(first)
    again = tables | {
        "entity": tables["entity"].unionByName(first.entities, allowMissingColumns=True), "entity_feature": tables["entity_feature"].unionByName(first.features, allowMissingColumns=True),
        "entity_group": tables["entity_group"].unionByName(first.pairs.select([c for c in first.pairs.columns if c in tables["entity_group"].columns]), allowMissingColumns=True), "service_match": tables["service_match"].unionByName(first.service_matches, allowMissingColumns=True),
    }
    second = pipeline.run(again, "r2", bandit.default_arms(spark))
    assert second.entities.count() == second.features.count() == second.pairs.count() == 0


def test_streams(spark, tmp_path, sf):
    from kindred.streaming import operators as st

    src = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(src)
    events = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = st.tumbling(events, "1 hour", "40 days").writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in st.tumbling(spark.read.parquet(src), "1 hour").select("window_start", "event_type", "n").collect()}
    assert {tuple(r) for r in spark.table("t").select("window_start", "event_type", "n").collect()} == want
    calls = events.select(F.col("user_id").alias("worker_id"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    q = st.breakers(calls, failures=2).writeStream.format("memory").queryName("b").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("b").where("state = 'open'").count() > 0


def test_learning_stream(spark, tmp_path):
    import datetime

    from kindred.streaming.operators import learn_arms

    arms, src = str(tmp_path / "arms"), str(tmp_path / "feedback")
    bandit.default_arms(spark).withColumn("version", F.lit(0)).write.partitionBy("version").parquet(arms)
    t0 = datetime.datetime(2024, 1, 1)
    d = spark.createDataFrame([("g", "r", "[1.0]", "email", 0.9, t0)], "entity_group_id string, pipeline_run_id string, snapshotted_features string, method_type_at_decision string, tuned_confidence double, created_at timestamp")
    spark.createDataFrame([("f", "g", True)], "id string, entity_group_id string, is_match_correct boolean").write.parquet(src)
    q = learn_arms(spark.readStream.schema("id string, entity_group_id string, is_match_correct boolean").parquet(src), d, arms, str(tmp_path / "cp"))
    q.awaitTermination()
    last = spark.read.parquet(arms)
    assert last.where("version = 1 and method = 'email' and target = 0.9").first().trials == 1
