"""More registered queries: workers, feedback, models, pair contexts, reviews and single expressions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import contact, documents, geo, urls, vectors
from kindred.operators import bandit, batching, blocking, entities, features, graph, jobs, matchers, stats, suggestions, workers
from kindred.plans.queries import _COMP, _FEATS, _GRAPH, _PHONES, _URLS, c, customer_features, graph_pairs, phone_rows, placed_pairs, query, r6, t, url_rows
from kindred.sources import io, storage



def now():
    return F.lit("2024-01-10 00:00:00").cast("timestamp")


# -- blocking and selection ---------------------------------------------------------------------
@query("SELECT page_id FROM pages WHERE url IS NOT NULL AND NOT regexp_full_match(url, '\\s*')")
def urls_not_blank(spark, sf):
    return t(spark, sf, "pages").where(blocking.not_blank(c("url"))).select("page_id")


@query(f"WITH {_URLS} SELECT entity_id_1, entity_id_2 FROM up WHERE entity_id_1 % 3 <> 0 AND entity_id_2 % 3 <> 0")
def valid_entity_pairs(spark, sf):
    known = t(spark, sf, "pages").where("page_id % 3 != 0").select(c("page_id").alias("entity_id"))
    # a pair depends on its own two rows alone, so unknown entities leave before pairs are made
    rows = url_rows(spark, sf).join(known.distinct(), "entity_id", "left_semi")
    return matchers.url_scored(rows, originals=False).select("entity_id_1", "entity_id_2")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def vectors_of_candidates(spark, sf):
    wanted = t(spark, sf, "labels").where("quality = 1").select(c("doc_id").alias("vec_id"))
    return io.read_table(spark, sf, "embeddings", ["vec_id", "label"]).join(wanted, "vec_id", "left_semi")


# -- workers: suppliers, whose beats are events ---------------------------------------------------
_WORKERS = """w AS (SELECT s_suppkey AS id, ['online', 'busy', 'offline', 'error'][s_suppkey % 4 + 1] AS status, CASE WHEN s_suppkey % 7 = 0 THEN 16 ELSE 64 END AS size, s_suppkey % 5 AS active_jobs, s_acctbal AS current_load, TIMESTAMP '2024-01-02 00:00:00' + to_hours((s_suppkey % 300)::INT) AS last_heartbeat FROM supplier)"""


def supplier_workers(spark, sf) -> DataFrame:
    k = c("s_suppkey")
    status = F.element_at(F.array(*map(F.lit, ("online", "busy", "offline", "error"))), (k % 4 + 1).cast("int"))
    caps = F.to_json(F.struct(F.when(k % 7 == 0, 16).otherwise(64).alias("max_batch_size"), F.lit(8).alias("optimal_batch_size")))
    beat = F.lit("2024-01-02 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(k % 300).cast("int"))
    return t(spark, sf, "supplier").select(k.alias("id"), status.alias("status"), caps.alias("capabilities"), (k % 5).alias("active_jobs"), c("s_acctbal").alias("current_load"), beat.alias("last_heartbeat"))


@query(f"WITH {_WORKERS} SELECT id FROM w WHERE status IN ('online', 'busy') AND id % 3 <> 1 AND size >= 32")
def available_workers(spark, sf):
    w = supplier_workers(spark, sf)
    return workers.available(w, w.where("id % 3 = 1").select("id", F.lit(False).alias("allows")), 32).select("id")


@query(f"WITH {_WORKERS} SELECT sum(size)::BIGINT AS total_capacity, sum(active_jobs)::BIGINT AS total_load, least(greatest(1, sum(size) - sum(active_jobs)), 1000)::BIGINT AS take FROM w WHERE status IN ('online', 'busy')")
def worker_capacity(spark, sf):
    return workers.capacity(supplier_workers(spark, sf), 1000).select(*[c(x).cast("long").alias(x) for x in ("total_capacity", "total_load", "take")])


@query(f"WITH {_WORKERS} SELECT (SELECT count(*) FROM w WHERE status IN ('online', 'busy')) AS active_workers, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS queue_depth")
def worker_status_summary(spark, sf):
    queue = t(spark, sf, "orders").select(F.when(c("o_orderstatus") == "O", "queued").otherwise("completed").alias("status"))
    return workers.status_summary(supplier_workers(spark, sf), queue)


@query(f"""WITH {_WORKERS}, b AS (SELECT user_id AS id, max(ts) AS beat, arg_max(value, (ts, event_id)) AS l, arg_max(event_id % 7, (ts, event_id)) AS j FROM events GROUP BY 1)
SELECT id, CASE WHEN beat IS NOT NULL AND status = 'offline' THEN 'online' ELSE status END AS status, round(coalesce(l, current_load), 6) AS current_load, coalesce(j, active_jobs)::BIGINT AS active_jobs, greatest(beat, last_heartbeat) AS last_heartbeat FROM w LEFT JOIN b USING (id)""")
def worker_heartbeats(spark, sf):
    beats = t(spark, sf, "events").select(c("user_id").alias("id"), c("ts").alias("at"), c("value").alias("load"), (c("event_id") % 7).alias("active_jobs"))
    return workers.heartbeat(supplier_workers(spark, sf), beats).select("id", "status", r6("current_load").alias("current_load"), "active_jobs", "last_heartbeat")


@query(f"WITH {_WORKERS} SELECT id FROM w WHERE NOT last_heartbeat < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 3 DAY")
def fresh_workers(spark, sf):
    return workers.drop_stale(supplier_workers(spark, sf), now(), 3 * 86_400).select("id")


@query("""SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey < 15 THEN 'gpu' ELSE 'cpu' END AS worker_type, CASE WHEN n_nationkey < 15 THEN 1 ELSE 2 END AS created_at, CASE WHEN n_nationkey < 10 THEN 'old' ELSE 'new' END AS status FROM nation WHERE n_nationkey <> 12""")
def worker_registry(spark, sf):
    n = t(spark, sf, "nation").select(c("n_nationkey").cast("long").alias("id"))
    row = lambda kind, at, status: n.select("id", F.lit(kind).alias("worker_type"), F.lit(at).alias("created_at"), F.lit(status).alias("status"))
    registered = workers.register(row("gpu", 1, "old").where("id < 15"), row("cpu", 2, "new").where("id >= 10"))
    return workers.deregister(registered, n.where("id = 12"))


# -- models: order priorities by status, saved twice -----------------------------------------------
def saved_models(spark, sf) -> DataFrame:
    model = lambda status: t(spark, sf, "orders").where(c("o_orderstatus") == status).groupBy(c("o_orderpriority").alias("arm")).agg(F.count("*").alias("trials"))
    none = spark.createDataFrame([], "id string, model_type string, parameters string, metrics string, version int")
    first = io.save_model(spark, model("F"), none, "tuner")
    return first.unionByName(io.save_model(spark, model("O"), first, "tuner"))


@query("SELECT sha256('tuner') AS id, 'tuner' AS model_type, unnest([1, 2])::INT AS version")
def model_versions(spark, sf):
    return saved_models(spark, sf).select("id", "model_type", "version")


@query("SELECT o_orderpriority AS arm, count(*) AS trials FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def model_latest(spark, sf):
    return io.load_model(saved_models(spark, sf), "tuner", "arm string, trials bigint")


# -- feedback: events on customers, whose orders are the decisions -----------------------------------
_FEEDBACK = """f AS (SELECT event_id AS id, user_id AS entity_group_id, ts, event_type <> 'error' AS ok, event_id % 3 = 0 AS done FROM events),
taken AS (SELECT * FROM f WHERE NOT done ORDER BY ts, id LIMIT 1000),
d AS (SELECT * FROM (SELECT o_custkey, o_orderpriority AS method, o_orderstatus AS st, round(o_totalprice, 2) AS tuned, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC) AS r FROM orders) WHERE r = 1)"""


def feedback_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    feedback = t(spark, sf, "events").select(c("event_id").alias("id"), c("user_id").alias("entity_group_id"), c("ts").alias("feedback_timestamp"), (c("event_type") != "error").alias("is_match_correct"), F.when(c("event_id") % 3 == 0, c("ts")).alias("processed_for_tuner_update_at"))
    snapshot = F.when(c("o_orderstatus") == "P", "not a list").otherwise("[0.5,1.0]")
    decisions = t(spark, sf, "orders").select(c("o_custkey").alias("entity_group_id"), c("o_orderdate").alias("created_at"), c("o_orderkey").cast("string").alias("pipeline_run_id"), c("o_orderpriority").alias("method_type_at_decision"), F.round("o_totalprice", 2).alias("tuned_confidence"), snapshot.alias("snapshotted_features"))
    return feedback, decisions


@query("SELECT event_id AS id FROM events WHERE event_id % 3 <> 0 ORDER BY ts, event_id LIMIT 1000")
def feedback_pending(spark, sf):
    return bandit.pending_feedback(feedback_tables(spark, sf)[0]).select("id")


@query(f"WITH {_FEEDBACK} SELECT method, tuned, ok::INT::DOUBLE AS reward, count(*) AS n FROM taken JOIN d ON o_custkey = entity_group_id WHERE st <> 'P' GROUP BY ALL")
def feedback_rewards(spark, sf):
    feedback, decisions = feedback_tables(spark, sf)
    return bandit.feedback_outcomes(bandit.pending_feedback(feedback), decisions).groupBy("method", "tuned", "reward").agg(F.count("*").alias("n"))


@query(f"WITH {_FEEDBACK} SELECT id, done OR id IN (SELECT id FROM taken) AS processed FROM f")
def feedback_marked(spark, sf):
    _, marked = bandit.process_feedback(bandit.default_arms(spark), *feedback_tables(spark, sf), now())
    return marked.select("id", c("processed_for_tuner_update_at").isNotNull().alias("processed"))


# -- pairs of customers and what is known of them ---------------------------------------------------
_PAIRS = """cp AS (SELECT a.c_custkey AS entity_id_1, b.c_custkey AS entity_id_2, a.c_mktsegment AS s1, b.c_mktsegment AS s2, a.c_nationkey AS n1, b.c_nationkey AS n2 FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 5 = 0),
seg AS (SELECT DISTINCT c_mktsegment AS s FROM customer), tri AS (SELECT s, list_distinct(list_transform(generate_series(1, length(s) + 1), lambda i: substr('  ' || lower(s) || ' ', i, 3))) AS g FROM seg),
place AS (SELECT c_custkey, c_nationkey % 5 * 0.02 + 10 AS lat, c_nationkey % 7 * 0.03 + 20 AS lon FROM customer),
dist AS (SELECT entity_id_1, entity_id_2, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS m FROM cp JOIN place a ON a.c_custkey = entity_id_1 JOIN place b ON b.c_custkey = entity_id_2),
pf AS (SELECT entity_id_1, entity_id_2, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS name_similarity, CASE WHEN m <= 10000 THEN 1 - m / 10000 ELSE 0 END AS geographic_proximity, (s1 = s2)::INT::DOUBLE AS shared_domain, (n1 % 4 = n2 % 4)::INT::DOUBLE AS shared_phone
  FROM cp JOIN dist USING (entity_id_1, entity_id_2) JOIN tri a ON a.s = s1 JOIN tri b ON b.s = s2)"""


def customer_pairs(spark, sf) -> DataFrame:
    k = t(spark, sf, "customer").select(c("c_custkey").alias("entity_id_1"), (c("c_custkey") + 1).alias("entity_id_2")).where("entity_id_1 % 5 = 0")
    return k.join(t(spark, sf, "customer").select(c("c_custkey").alias("entity_id_2")), "entity_id_2", "left_semi")


def customer_pair_values(spark, sf) -> DataFrame:
    cu = t(spark, sf, "customer").withColumnRenamed("c_custkey", "entity_id")
    none = F.lit(None).cast("array<double>")
    org = cu.select("entity_id", c("c_mktsegment").alias("name"), F.concat(F.lit("https://www."), F.lower("c_mktsegment"), F.lit(".org/about")).alias("url"), none.alias("embedding"))
    place = cu.select("entity_id", (c("c_nationkey") % 5 * 0.02 + 10).alias("lat"), (c("c_nationkey") % 7 * 0.03 + 20).alias("lon"))
    phones = cu.select("entity_id", F.concat(F.lit("555-010"), (c("c_nationkey") % 4).cast("string")).alias("number"))
    vec = cu.select("entity_id", none.alias("embedding"))
    return features.pair_feature_values(customer_pairs(spark, sf), org, vec, place, phones, place.withColumn("embedding", none))


@query(f"WITH {_PAIRS} SELECT entity_id_1, entity_id_2, round(name_similarity, 6) AS name_similarity, 0.0::DOUBLE AS embedding_similarity, 0.0::DOUBLE AS max_service_similarity, round(geographic_proximity, 4) AS geographic_proximity, shared_domain, shared_phone, 0.0::DOUBLE AS service_geo_similarity FROM pf")
def pair_features(spark, sf):
    return customer_pair_values(spark, sf).withColumn("name_similarity", r6("name_similarity")).withColumn("geographic_proximity", F.round("geographic_proximity", 4))


def customer_contexts(spark, sf) -> DataFrame:
    return features.pair_contexts(customer_pairs(spark, sf), customer_features(spark, sf), customer_pair_values(spark, sf))


_CONTEXTS = f"""{_FEATS}, {_PAIRS},
cx AS (SELECT pf.*, a.name_complexity AS a0, a.organization_size AS a7, b.data_completeness AS b1, b.service_count AS b8 FROM pf JOIN fe a ON a.entity_id = entity_id_1 JOIN fe b ON b.entity_id = entity_id_2)"""


@query(f"WITH {_CONTEXTS} SELECT entity_id_1, entity_id_2, 31::BIGINT AS n, round(a0, 6) AS a_name_complexity, round(a7, 6) AS a_size, round(b1, 6) AS b_completeness, round(b8, 6) AS b_services, round(name_similarity, 6) AS name_similarity, round(geographic_proximity, 4) AS proximity, shared_domain, shared_phone FROM cx")
def pair_context_vectors(spark, sf):
    f = c("features")
    return customer_contexts(spark, sf).select(
        "entity_id_1", "entity_id_2", F.size(f).cast("long").alias("n"), r6(f[0]).alias("a_name_complexity"), r6(f[7]).alias("a_size"), r6(f[13]).alias("b_completeness"), r6(f[20]).alias("b_services"),
        r6(f[24]).alias("name_similarity"), F.round(f[27], 4).alias("proximity"), f[28].alias("shared_domain"), f[29].alias("shared_phone"),
    )


@query(f"WITH {_CONTEXTS} SELECT entity_id_1 || '-' || entity_id_2 AS entity_group_id, 'url' AS method, 0.9::DOUBLE AS pre, round(name_similarity, 6) AS tuned, 3 AS version, 31::BIGINT AS n, round(a0, 6) AS first FROM cx")
def decision_snapshots(spark, sf):
    pairs = customer_pair_values(spark, sf).select("entity_id_1", "entity_id_2", F.concat_ws("-", "entity_id_1", "entity_id_2").alias("id"), F.lit("url").alias("method_type"), F.lit(0.9).alias("pre_rl_confidence_score"), r6("name_similarity").alias("confidence_score"))
    d = bandit.decision_details(pairs, customer_contexts(spark, sf), "run", 3, now()).withColumn("f", F.from_json("snapshotted_features", "array<double>"))
    return d.select("entity_group_id", c("method_type_at_decision").alias("method"), c("pre_rl_confidence").alias("pre"), c("tuned_confidence").alias("tuned"), c("confidence_tuner_version").alias("version"), F.size("f").cast("long").alias("n"), r6(c("f")[0]).alias("first"))


@query("SELECT n AS name, s AS scope, 0.0::DOUBLE AS least, m::DOUBLE AS most FROM (VALUES " + ", ".join(f"('{x}', 'entity', {2 if 'distance' in x else 1})" for x in features.ENTITY_FEATURES) + ", " + ", ".join(f"('{x}', 'pair', 1)" for x in features.PAIR_FEATURES) + ") AS v(n, s, m)")
def feature_bounds(spark, sf):
    return features.feature_catalog(spark)


# -- clusters and suggestions ----------------------------------------------------------------------
_COHERENCE = "sc AS (SELECT l_orderkey::VARCHAR AS id, avg(l_discount * 10) AS score FROM lineitem GROUP BY 1 HAVING count(*) <= 20)"


def line_clusters(spark, sf) -> DataFrame:
    line = t(spark, sf, "lineitem")
    pairs = line.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), c("l_orderkey").cast("string").alias("group_cluster_id"), (c("l_discount") * 10).alias("confidence_score"), F.lit(None).cast("double").alias("pre_rl_confidence_score"))
    return graph.sized_coherence(pairs).where("pairs <= 20").drop("pairs")


@query(f"WITH {_COHERENCE} SELECT id, round(score, 6) AS average_coherence_score, round(score, 9) < 0.7 AS suggest_split FROM sc")
def cluster_coherence(spark, sf):
    return line_clusters(spark, sf).select("id", r6("average_coherence_score").alias("average_coherence_score"), (F.round("average_coherence_score", 9) < 0.7).alias("suggest_split"))


@query(f"WITH {_COHERENCE} SELECT id AS cluster_id, 'SUGGEST_SPLIT_CLUSTER' AS action_type, 'LOW_INTERNAL_CLUSTER_COHERENCE' AS reason_code, 1 AS priority, 'PENDING_REVIEW' AS status, round(score, 6) AS triggering_confidence FROM sc WHERE round(score, 9) < 0.7")
def split_suggestions(spark, sf):
    scores = line_clusters(spark, sf).withColumn("suggest_split", F.round("average_coherence_score", 9) < 0.7)
    return suggestions.split_clusters(scores, "run").select("cluster_id", "action_type", "reason_code", "priority", "status", r6("triggering_confidence").alias("triggering_confidence"))


@query(f"WITH {_COHERENCE} SELECT id FROM (SELECT id, round(score, 6) AS s FROM sc) ORDER BY s, id LIMIT 10")
def lowest_coherence(spark, sf):
    return stats.lowest_coherence(line_clusters(spark, sf).withColumn("average_coherence_score", r6("average_coherence_score"))).select("id")


@query("SELECT o_custkey::VARCHAR AS group_id_1, o_orderkey::VARCHAR AS group_id_2, 'REVIEW_INTER_GROUP_LINK' AS action_type, 'WEAK_INTER_GROUP_EDGE' AS reason_code, 0 AS priority, round((o_orderkey % 50) / 250.0, 6)::DOUBLE AS triggering_confidence FROM orders WHERE o_orderkey % 50 BETWEEN 1 AND 24")
def weak_link_suggestions(spark, sf):
    links = t(spark, sf, "orders").select(c("o_custkey").alias("source_id"), c("o_orderkey").alias("target_id"), (c("o_orderkey") % 50 / 250.0).alias("weight"), F.array(F.struct("o_orderkey")).alias("shared"))
    return suggestions.insertable(suggestions.weak_links(links, "run")).select("group_id_1", "group_id_2", "action_type", "reason_code", "priority", r6("triggering_confidence").alias("triggering_confidence"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'APPROVED' ELSE 'PENDING_REVIEW' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'ann' END AS reviewer_id, CASE WHEN o_orderkey % 6 = 0 THEN 'seen' ELSE 'first' END AS review_notes FROM orders""")
def suggestion_reviews(spark, sf):
    null = F.lit(None)
    stored = t(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.lit("PENDING_REVIEW").alias("status"), null.cast("string").alias("reviewer_id"), null.cast("timestamp").alias("reviewed_at"), F.lit("first").alias("review_notes"))
    decided = stored.where("id % 3 = 0").select("id", F.lit("ann").alias("reviewer_id"), F.lit("APPROVED").alias("status"), now().alias("reviewed_at"), F.when(c("id") % 6 == 0, "seen").alias("review_notes"))
    return suggestions.review(stored, decided).select("id", "status", "reviewer_id", "review_notes")


@query(f"WITH {_GRAPH} SELECT source_id AS source_group_id, target_id AS target_group_id, round(1 - product(1 - w), 6) AS calculated_edge_weight, count(*) AS shared_entities FROM lk0 GROUP BY ALL")
def formation_edges(spark, sf):
    e = graph.formation_edges(graph.pair_graph(graph_pairs(spark, sf)), "run")
    return e.select("source_group_id", "target_group_id", r6("calculated_edge_weight").alias("calculated_edge_weight"), F.json_array_length("contributing_shared_entities").cast("long").alias("shared_entities"))


_PLACED = f"{_COMP}, pl AS (SELECT name_1 || '|' || name_2 AS id, name_1, name_2, coalesce(community, name_1 || '|' || name_2) AS community FROM gp LEFT JOIN comp ON id = name_1 || '|' || name_2)"


@query(f"{_PLACED} SELECT id, sha256('cluster|' || community) AS group_cluster_id FROM pl")
def cluster_assignment(spark, sf):
    return placed_pairs(spark, sf).select("id", "group_cluster_id")


@query(f"""{_PLACED}, sizes AS (SELECT community, count(DISTINCT id) AS groups, count(DISTINCT e) AS entities FROM (SELECT community, id, unnest([name_1, name_2]) AS e FROM pl) GROUP BY 1)
SELECT sha256('cluster|' || community) AS id, 'LeidenCluster-' || substr(sha256('cluster|' || community), 1, 8) AS name, 'Cluster of ' || entities || ' entities from ' || groups || ' pairs' AS description FROM sizes""")
def cluster_labels(spark, sf):
    pairs = graph_pairs(spark, sf)
    return graph.clusters(pairs, graph.communities(graph.pair_graph(pairs), "components")).select("id", "name", "description")


# -- stored runs and embeddings --------------------------------------------------------------------
@query("SELECT 'r' AS id, 'test' AS description, (SELECT count(*) FROM customer) AS total_entities, (SELECT count(*) FROM orders) AS total_groups, 0::BIGINT AS total_clusters, 4.5::DOUBLE AS total_processing_time")
def run_record(spark, sf):
    row = stats.finished_run(stats.initial_run(spark, "r", "test"), {"total_entities": t(spark, sf, "customer"), "total_groups": t(spark, sf, "orders")}, {"matching_time": 3.0, "clustering_time": 1.5, "visualization_time": 9.0})
    return row.select("id", "description", "total_entities", "total_groups", "total_clusters", "total_processing_time")


@query("SELECT n_nationkey::BIGINT AS k, 'r' || (n_nationkey % 2) AS pipeline_run_id, CASE WHEN n_nationkey % 2 = 1 THEN 'again' ELSE 'first' END AS note FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey > 9")
def run_overwritten(spark, sf):
    """A run's rows are replaced by its second writing, other runs stay."""
    path = storage.new_path(spark, "runs")
    rows = t(spark, sf, "nation").select(c("n_nationkey").cast("long").alias("k"), F.concat(F.lit("r"), (c("n_nationkey") % 2).cast("string")).alias("pipeline_run_id"))
    io.overwrite_run(rows.withColumn("note", F.lit("first")), path)
    io.overwrite_run(rows.where("pipeline_run_id = 'r1' and k > 9").withColumn("note", F.lit("again")), path)
    return spark.read.schema("k long, note string, pipeline_run_id string").parquet(path)


@query("SELECT vec_id AS id, vec_id % 4 <> 2 AS has_vector, vec_id % 4 = 0 AS changed, label FROM embeddings WHERE embedding IS NOT NULL")
def stored_embeddings(spark, sf):
    e = t(spark, sf, "embeddings").where("embedding is not null")
    services = e.select(c("vec_id").alias("id"), "label", F.when(c("vec_id") % 2 == 1, c("embedding")).alias("embedding_v2"), F.lit(None).cast("timestamp").alias("embedding_v2_updated_at"))
    results = e.where("vec_id % 4 = 0").select(c("vec_id").alias("service_id"), "embedding")
    out = jobs.store_embeddings(services, results, now())
    return out.select("id", c("embedding_v2").isNotNull().alias("has_vector"), c("embedding_v2_updated_at").isNotNull().alias("changed"), "label")


@query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS entity_id, c_name AS name, coalesce(n, 0) AS services, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS phones FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def entity_cards(spark, sf):
    cu, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    people = cu.select(c("c_custkey").alias("id"), c("c_custkey").alias("organization_id"), c("c_name").alias("name"))
    orders = o.select(c("o_custkey").alias("entity_id"), F.lit("service").alias("table_name"), c("o_orderkey").alias("table_id"))
    phones = cu.where("c_custkey % 2 = 0").select("c_custkey", F.lit("phone"), "c_custkey")
    none = spark.createDataFrame([], "id long, x string")
    tables = {"service": o.select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("x")), "phone": cu.select(c("c_custkey").alias("id"), c("c_name").alias("x")), "location": none, "contact": none}
    n = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    card = entities.entity_card(people, orders.union(phones), tables)
    return card.select("entity_id", "name", F.greatest(n(c("services")), F.lit(0)).alias("services"), F.greatest(n(c("phones")), F.lit(0)).alias("phones"))


# -- single expressions ----------------------------------------------------------------------------
_HOSTS = """h AS (SELECT s_suppkey AS k, CASE s_suppkey % 10 WHEN 0 THEN '10.1.2.' || s_suppkey % 200 WHEN 1 THEN '8.8.4.' || s_suppkey % 200 WHEN 2 THEN '192.168.7.1' WHEN 3 THEN '172.' || (s_suppkey % 40) || '.0.9' WHEN 4 THEN '300.1.1.1' WHEN 5 THEN '::1' WHEN 6 THEN '2001:db8::5' WHEN 7 THEN 'fe80::1' WHEN 8 THEN 'shop' || s_suppkey || '.org' ELSE '127.0.0.1' END AS host FROM supplier)"""


@query(f"WITH {_HOSTS} SELECT k, host, k % 10 IN (1, 6) OR (k % 10 = 3 AND k % 40 NOT BETWEEN 16 AND 31) AS public_ip FROM h")
def public_ip_hosts(spark, sf):
    k = c("s_suppkey")
    text = lambda x: x.cast("string")
    kinds = [F.concat(F.lit("10.1.2."), text(k % 200)), F.concat(F.lit("8.8.4."), text(k % 200)), F.lit("192.168.7.1"), F.concat(F.lit("172."), text(k % 40), F.lit(".0.9")), F.lit("300.1.1.1"), F.lit("::1"), F.lit("2001:db8::5"), F.lit("fe80::1"), F.concat(F.lit("shop"), text(k), F.lit(".org")), F.lit("127.0.0.1")]
    host = F.element_at(F.array(*kinds), (k % 10 + 1).cast("int"))
    return t(spark, sf, "supplier").select(k.alias("k"), host.alias("host"), urls.is_public_ip(host).alias("public_ip"))


@query(f"WITH {_PHONES} SELECT doc_id, number, regexp_replace(number, '[^0-9]', '', 'g') = key AS same FROM p3")
def phone_same_digits(spark, sf):
    return phone_rows(spark, sf).select(c("entity_id").alias("doc_id"), "number", contact.same_digits(c("number"), contact.normalize_phone(c("number"))).alias("same"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages WHERE url LIKE 'http%'")
def url_hosts(spark, sf):
    return t(spark, sf, "pages").where("url like 'http%'").select("page_id", urls.host_of(c("url")).alias("host"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE s_name || ' number ' || s_suppkey END AS text FROM supplier")
def organization_texts(spark, sf):
    about = F.when(c("s_suppkey") % 3 != 0, F.concat(F.lit("number "), c("s_suppkey").cast("string")))
    return t(spark, sf, "supplier").select("s_suppkey", documents.organization_text(c("s_name"), about).alias("text"))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) + strlen(text) // 4 END::BIGINT AS tokens FROM documents")
def fallback_token_count(spark, sf):
    return t(spark, sf, "documents").select("doc_id", documents.fallback_tokens(c("text")).cast("long").alias("tokens"))


@query("SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'urgent' ELSE 'normal' END AS priority, o_orderstatus = 'F' AS same FROM orders")
def checked_values(spark, sf):
    padded = F.concat(F.lit(" "), "o_orderstatus", F.lit("  "))
    word = F.upper(F.regexp_extract("o_orderpriority", r"-(\w+)", 1))
    return t(spark, sf, "orders").select("o_orderkey", io.checked(padded, ["O", "F", "P"], "status").alias("status"), io.or_default(word, ["urgent", "normal"], "normal").alias("priority"), io.same_id(padded, F.lit("F ")).alias("same"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)
SELECT vec_id, round(CASE WHEN label % 2 = 1 THEN (v[1] + v[-1]) / 2 ELSE v[1] END, 5) AS pooled, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS head,
array_to_string(list_transform(generate_series(1, 5), lambda i: CASE WHEN i <= label THEN i ELSE 0 END), ' ') AS padded, array_to_string(list_transform(generate_series(1, 5), lambda i: CASE WHEN i <= label THEN 1 ELSE 0 END), ' ') AS mask FROM e""")
def pooled_vectors(spark, sf):
    e = t(spark, sf, "embeddings").where("embedding is not null and label is not null")
    states = F.array("embedding", F.reverse("embedding"))
    ids = F.filter(F.sequence(F.lit(1), F.lit(10)), lambda i: i <= c("label"))
    text = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), " ")
    return e.select("vec_id", F.round(vectors.mean_pool(states, F.array(F.lit(1), c("label") % 2))[0], 5).alias("pooled"), F.round(vectors.cls_pool(states)[0], 5).alias("head"), text(vectors.pad(ids, 5)).alias("padded"), text(vectors.pad_mask(ids, 5)).alias("mask"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0.0 WHEN coalesce(text, '') = '' THEN 0.1 WHEN length(text) < 20 THEN 0.3 WHEN length(text) < 100 THEN 0.6 ELSE 0.9 END::DOUBLE AS quality FROM documents")
def embedding_quality(spark, sf):
    vector = F.when(c("doc_id") % 5 != 0, F.array(F.lit(1.0)))
    return t(spark, sf, "documents").select("doc_id", features.embedding_quality(vector, c("text")).alias("quality"))


@query("""WITH e AS (SELECT event_id, event_id % 64 + 1 AS size, event_id % 101 AS mem, event_id % 97 AS cpu FROM events)
SELECT event_id, greatest(least(CASE WHEN mem > 85 THEN floor(size * 0.8) WHEN mem < 60 AND cpu < 60 THEN ceil(size * 1.2) ELSE size END, 48, 40), 4)::INT AS early, greatest(least(CASE WHEN mem > 90 THEN floor(size * 0.8) WHEN cpu < 50 AND mem < 70 THEN ceil(size * 1.2) ELSE size END, 48), 4)::INT AS later FROM e""")
def early_batch_size(spark, sf):
    size, mem, cpu = c("event_id") % 64 + 1, c("event_id") % 101, c("event_id") % 97
    return t(spark, sf, "events").select("event_id", batching.early_size(size, mem, cpu, F.lit(4000), F.lit(100), 4, 48).alias("early"), batching.adjusted(size, mem, cpu, 4, 48).alias("later"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.s_suppkey - a.s_suppkey) / 20), 2))), 0) AS metres FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1""")
def meridian_distances(spark, sf):
    s = t(spark, sf, "supplier").select(c("s_suppkey").alias("a"), (c("s_suppkey") + 1).alias("b"))
    near = s.join(s.select(c("a").alias("b")), "b", "left_semi")
    return near.select("a", "b", F.round(geo.haversine(c("a") / 10, F.lit(7.0), c("b") / 10, F.lit(7.0)), 0).alias("metres"))
