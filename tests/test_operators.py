import datetime

import pytest
from pyspark.sql import functions as F

from kindred.operators import bandit, batching, blocking, components, encoder, entities, graph, jobs, matchers, services, suggestions, workers
from kindred.sources import io, schemas, settings

c = F.col
T0 = datetime.datetime(2024, 1, 1)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_entities_idempotent(spark):
    org = spark.createDataFrame([("o1", "A"), ("o2", "B")], "id string, name string")
    none = spark.createDataFrame([], "id string, organization_id string, name string")
    first = entities.extract_entities(org, none)
    assert {r.organization_id for r in first.collect()} == {"o1", "o2"}
    assert entities.extract_entities(org, first).count() == 0
    assert rows(first, "id") == rows(entities.extract_entities(org, none), "id")


def directory(spark):
    mk = spark.createDataFrame
    return {
        "service": mk([("s1", "o1"), ("s2", "o1")], "id string, organization_id string"),
        "phone": mk([("p1", "o1", None, None, None), ("p2", None, "s1", "x", None), ("p3", None, None, "x", None), ("p4", None, None, None, "c1"), ("p5", None, None, None, None)], "id string, organization_id string, service_id string, service_at_location_id string, contact_id string"),
        "service_at_location": mk([("x", "s2", "l2")], "id string, service_id string, location_id string"),
        "location": mk([("l1", "o1"), ("l2", None)], "id string, organization_id string"),
        "contact": mk([("c1", "o1")], "id string, organization_id string"),
    }


def test_links(spark):
    e = spark.createDataFrame([("e1", "o1", "A")], "id string, organization_id string, name string")
    none = spark.createDataFrame([], "entity_id string, table_name string, table_id string")
    links = entities.link_entity_features(e, directory(spark), none)
    got = {(r.table_name, r.table_id) for r in links.collect()}
    assert got == {("service", "s1"), ("service", "s2"), ("phone", "p1"), ("phone", "p2"), ("phone", "p3"), ("phone", "p4"), ("location", "l1"), ("location", "l2"), ("contact", "c1")}
    assert entities.link_entity_features(e, directory(spark), links).count() == 0


def test_blocked_pairs_and_existing(spark):
    r = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3), ("z", 9)], "key string, e long")
    pairs = blocking.blocked_pairs(r, "key", "e")
    assert rows(pairs.select("entity_id_1", "entity_id_2"), "entity_id_1", "entity_id_2") == [(1, 2), (1, 3), (2, 3)]
    old = spark.createDataFrame([(3, 1, "email")], "entity_id_1 long, entity_id_2 long, method_type string")
    assert blocking.exclude_existing(pairs, old, "email").count() == 2 and blocking.exclude_existing(pairs, old, "url").count() == 3


def test_email_matcher_dedupes_keys(spark):
    r = spark.createDataFrame([(1, "A@x.org"), (2, "a+1@x.org"), (1, "info@x.org"), (2, "info@x.org"), (3, None), (4, "")], "entity_id long, email string")
    got = matchers.match_emails(r).collect()
    assert len(got) == 1 and got[0].confidence_score == 1.0 and '"type":"Email"' in got[0].match_values


def test_near_pairs_equal_brute_force(spark):
    p = spark.range(150).select(c("id").alias("entity_id"), (40 + F.pmod(c("id") * 7919, F.lit(997)) / 20000.0).alias("lat"), (-100 + F.pmod(c("id") * 104729, F.lit(991)) / 20000.0).alias("lon"))
    from kindred.functions.geo import haversine

    a, b = p.toDF("i", "a", "b"), p.toDF("j", "p", "q")
    brute = a.join(b, (c("i") < c("j")) & (haversine(c("a"), c("b"), c("p"), c("q")) <= 1500)).select("i", "j")
    assert rows(matchers.near_pairs(p, 1500).select("entity_id_1", "entity_id_2"), "entity_id_1", "entity_id_2") == rows(brute, "i", "j")


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and len(got) == 44
    assert components.components(links.where("a > 1000")).count() == 0


def test_pair_graph_and_noisy_or(spark):
    schema = "id string, entity_id_1 string, entity_id_2 string, confidence_score double"
    one = spark.createDataFrame([("p", "A", "B", 0.9), ("q", "B", "C", 0.8)], schema)
    assert graph.pair_graph(one).first().weight == pytest.approx(0.85)
    two = spark.createDataFrame([("p", "A", "B", 1.0), ("q", "A", "B", 0.95)], schema)
    assert graph.pair_graph(two).first().weight == pytest.approx(0.999375)
    assert graph.pair_graph(spark.createDataFrame([("p", "A", "B", None), ("q", "B", "C", None)], schema)).count() == 0


def test_communities_split_two_cliques(spark):
    k = [(f"{g}{i}", f"{g}{j}", 0.9) for g in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 0.1)]
    got = {r.id: r.community for r in graph.communities(spark.createDataFrame(k, "source_id string, target_id string, weight double")).collect()}
    assert {got[f"a{i}"] for i in range(5)} == {"a0"} and {got[f"b{i}"] for i in range(5)} == {"b0"}


def test_split_simulation(spark):
    edges = spark.createDataFrame([("c", "1", "2"), ("c", "2", "3"), ("d", "1", "2"), ("d", "2", "3"), ("d", "1", "3")], "cluster_id string, entity_id_1 string, entity_id_2 string")
    gone = spark.createDataFrame([("c", "1", "2"), ("d", "1", "2")], edges.schema)
    assert rows(graph.simulate_split(edges, gone), "cluster_id") == [("c", True, 2), ("d", False, 1)]


def test_tuner_without_trials(spark):
    got = {r.method: r.chosen for r in bandit.choices(bandit.default_arms(spark)).collect()}
    assert got == {"email": 1.0, "phone": 0.98, "url": 0.95, "address": 0.95, "name": 0.95, "geospatial": 0.90, "default": 0.90}
    pairs = spark.createDataFrame([("1", "2", "custom", 0.5), ("1", "2", "phone", 0.5)], "entity_id_1 string, entity_id_2 string, method_type string, confidence_score double")
    assert {r.method_type: r.confidence_score for r in bandit.tune(pairs, bandit.default_arms(spark)).collect()} == {"custom": 0.90, "phone": 0.98}


def test_feedback_moves_arms(spark):
    f = spark.createDataFrame([("f1", "g1", "r", True, T0), ("f2", "g2", "r", False, T0), ("f3", "g3", "r", True, T0)], "id string, entity_group_id string, reviewer_id string, is_match_correct boolean, feedback_timestamp timestamp").withColumn("processed_for_tuner_update_at", F.lit(None).cast("timestamp"))
    d = spark.createDataFrame([("g1", "r1", "[1.0]", "email", 0.9, T0), ("g2", "r1", "[1.0]", "email", 0.9, T0), ("g3", "r1", "[]", "email", 0.9, T0)], "entity_group_id string, pipeline_run_id string, snapshotted_features string, method_type_at_decision string, tuned_confidence double, created_at timestamp")
    arms, marked = bandit.process_feedback(bandit.default_arms(spark), f, d, F.lit(T0))
    hit = arms.where("method = 'email' and target = 0.9").first()
    assert (hit.reward, hit.trials) == (1.0, 2) and marked.where("processed_for_tuner_update_at is null").count() == 0


def test_reviewer_weight(spark):
    f = spark.createDataFrame([("a", True)] * 3 + [("a", False), ("ml_system", False)], "reviewer_id string, was_correct boolean")
    assert bandit.reviewer_weight(f).first()[0] == pytest.approx(0.7) and bandit.reviewer_weight(f.where("false")).first()[0] == 0.6


def test_suggestion_priorities(spark):
    p = spark.createDataFrame([("a", "1", "2", "url", "{}", 0.84), ("b", "1", "3", "url", "{}", 0.29), ("c", "2", "3", "url", "{}", 0.85)], "id string, entity_id_1 string, entity_id_2 string, method_type string, match_values string, confidence_score double")
    assert {r.group_id_1: r.priority for r in suggestions.low_confidence(p, "r").collect()} == {"a": 1, "b": 2}


def test_services(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.99, 0.1]), (1, "z", [0.0, 0.0]), (1, "d", [1.0, 0.05]), (2, "e", [1.0, 0.0])], "cluster_id long, service_id string, embedding array<double>")
    places = spark.createDataFrame([("a", 40.0, -100.0), ("b", 41.0, -100.0)], "service_id string, lat double, lon double")
    got = services.match_services(v, places)
    assert {(r.service_id_1, r.service_id_2) for r in got.collect()} == {("a", "d"), ("b", "d")}
    assert services.match_services(v, places, got).count() == 0
    small = services.similar_within(v, "cluster_id", "service_id", "embedding", 0.85, block_rows=1)
    assert {(r.service_id_1, r.service_id_2) for r in small.collect()} == {("a", "b"), ("a", "d"), ("b", "d")}


def job(spark, *given):
    base = dict.fromkeys(c.strip().split()[0] for c in schemas.JOBS.split(","))
    return spark.createDataFrame([tuple((base | {"retry_count": 0, "created_at": T0, "updated_at": T0} | g).values()) for g in given], schemas.JOBS)


def test_jobs(spark):
    j = job(spark, {"id": "1", "service_id": "s1", "status": "queued"}, {"id": "2", "service_id": "s2", "status": "queued"}, {"id": "3", "service_id": "s3", "status": "processing", "worker_id": "w", "batch_id": "b"})
    now = F.lit(T0 + datetime.timedelta(minutes=31))
    claimed = jobs.claim_jobs(j, "w", 5, now)
    assert {(r.id, r.status, r.retry_count) for r in claimed.collect()} == {("1", "fetched", 0), ("2", "fetched", 0)} and claimed.first().batch_id
    back = {r.id: r for r in jobs.reset_stale(j, 30, now).collect()}
    assert back["3"].status == "queued" and back["3"].worker_id is None and back["1"].error_message is None
    assert jobs.reset_stale(j, 32, now).where("status = 'processing'").count() == 1
    s = spark.createDataFrame([("s1", None), ("s9", None)], "id string, embedding_v2 array<float>")
    assert [r.service_id for r in jobs.queue_new_jobs(s, j, 10, now).collect()] == ["s9"]
    results = spark.createDataFrame([("1", [1.0], 3)], "job_id string, embedding array<float>, tokens int")
    after = {r.id: r for r in jobs.apply_events(claimed, jobs.settle_results(claimed, results), now).collect()}
    assert after["1"].status == "completed" and after["2"].status == "failed" and after["2"].retry_count == 1
    deal = jobs.claim_for_workers(j, spark.createDataFrame([("w1", 1), ("w2", 5)], "worker_id string, take int"))
    assert rows(deal.select("job_id", "worker_id"), "job_id") == [("1", "w1"), ("2", "w2")]


def test_breakers_and_round_robin(spark):
    e = spark.createDataFrame([("w", T0 + datetime.timedelta(seconds=i), i, False) for i in range(5)] + [("v", T0, 9, False), ("v", T0 + datetime.timedelta(seconds=1), 10, True)], "worker_id string, at timestamp, seq long, ok boolean")
    at = lambda s: F.lit(T0 + datetime.timedelta(seconds=s))
    assert {r.id: r.state for r in workers.breaker_states(e, at(10)).collect()} == {"w": "open", "v": "closed"}
    assert {r.id: r.state for r in workers.breaker_states(e, at(400)).collect()}["w"] == "half_open"
    ring = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r.worker_id for r in workers.round_robin(spark.range(5).toDF("i"), "i", ring).orderBy("i").collect()] == list("ababa")


def test_batch_sizes(spark):
    assert batching.next_size(16, True, 0, 1, 16) == (16, 1) and batching.next_size(16, False, 3, 1, 64) == (12, 0)
    assert batching.next_size(32, True, 5, 1, 64) == (32, 6)
    e = spark.createDataFrame([("w", T0 + datetime.timedelta(seconds=i), i, ok) for i, ok in enumerate([True, False, True])], "worker_id string, at timestamp, event_id long, ok boolean")
    size, streak = 16, 0
    for ok in (True, False, True):
        size, streak = batching.next_size(size, ok, streak, 1, 64)
    assert rows(batching.replay_sizes(e, 16, 1, 64)) == [("w", size, streak)]


def test_merge_and_friends(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, made long")
    new = spark.createDataFrame([(2, "B", 9), (3, "C", 9)], old.schema)
    assert rows(io.merge(old, new, ["k"], keep=["made"]), "k") == [(1, "a", 1), (2, "B", 2), (3, "C", 9)]
    assert rows(io.new_rows(new.union(new), old, ["k"]), "k") == [(3, "C", 9)]
    assert rows(io.set_where(old, spark.createDataFrame([(1, "x"), (2, None)], "k long, v string"), ["k"], ["v"]), "k") == [(1, "x", 1), (2, "b", 2)]
    path = str(tmp_path / "runs")
    for _ in range(2):
        io.overwrite_run(old.withColumn("pipeline_run_id", F.lit("r1")), path)
    io.overwrite_run(new.withColumn("pipeline_run_id", F.lit("r2")), path)
    assert spark.read.parquet(path).count() == 4
    models = spark.createDataFrame([], schemas.MODELS)
    arms = bandit.default_arms(spark)
    models = models.union(io.save_model(spark, arms, models, "tuner"))
    models = models.union(io.save_model(spark, arms.withColumn("trials", F.lit(7).cast("long")), models, "tuner"))
    assert io.load_model(models, "tuner", bandit.ARM_SCHEMA).where("trials = 7").count() == arms.count()


def test_settings():
    env = {"B": "kept"}
    assert settings.load_env("# no\nA=1\nB=2\n\nC='x y'\n", env) == {"A": "1", "C": "x y"} and env["B"] == "kept"
    assert settings.from_env(settings.WorkerSettings, {"MAX_BATCH": "8"}).max_batch == 8


def test_encoder(spark):
    r = spark.createDataFrame([("1", "food bank"), ("2", "food bank"), ("3", None), ("4", "  ")], "id string, text string")
    got = {x.id: x.embedding for x in encoder.embed(r, "id", "text").collect()}
    assert set(got) == {"1", "2"} and got["1"] == got["2"] and len(got["1"]) == encoder.DIMENSIONS


def test_checked_values(spark):
    r = spark.createDataFrame([(" queued ",), (None,)], "s string")
    assert rows(r.select(io.checked(c("s"), schemas.JOB_STATUS, "status"))) == [("queued",), (None,)]
    with pytest.raises(Exception, match="unknown status"):
        spark.createDataFrame([("odd",)], "s string").select(io.checked(c("s"), schemas.JOB_STATUS, "status")).collect()
