"""Schemas of the tables that the engine reads and writes, as Spark DDL."""

from __future__ import annotations

ORGANIZATION = "id string, name string, description string, email string, url string, tax_id string, legal_status string, embedding array<float>, embedding_updated_at timestamp"
SERVICE = "id string, organization_id string, name string, description string, short_description string, url string, email string, status string, embedding_v2 array<float>, embedding_v2_updated_at timestamp"
PHONE = "id string, number string, extension string, organization_id string, service_id string, service_at_location_id string, contact_id string"
LOCATION = "id string, organization_id string, latitude double, longitude double"
ADDRESS = "location_id string, address_1 string, address_2 string, city string, state_province string, postal_code string, country string"
SERVICE_AT_LOCATION = "id string, service_id string, location_id string"
CONTACT = "id string, organization_id string"
SERVICE_TAXONOMY = "service_id string, taxonomy_term_id string"
TAXONOMY_TERM = "id string, term string, description string, taxonomy string"
ENTITY = "id string, organization_id string, name string, created_at timestamp, updated_at timestamp, source_system string, source_id string"
ENTITY_FEATURE = "id string, entity_id string, table_name string, table_id string, created_at timestamp"
ENTITY_GROUP = "id string, entity_id_1 string, entity_id_2 string, method_type string, match_values string, confidence_score double, pre_rl_confidence_score double, group_cluster_id string"
GROUP_CLUSTER = "id string, name string, description string, entity_count long, group_count long, average_coherence_score double"
SERVICE_MATCH = "id string, group_cluster_id string, service_id_1 string, service_id_2 string, similarity_score double, match_reasons string, status string, reviewed_by string, reviewed_at timestamp"
ENTITY_EDGES = "id string, cluster_id string, entity_id_1 string, entity_id_2 string, edge_weight double, details string, pipeline_run_id string"
CONTEXT_FEATURES = "id string, entity_id string, feature_name string, feature_value double, created_at timestamp"
DECISIONS = "entity_group_id string, pipeline_run_id string, snapshotted_features string, method_type_at_decision string, pre_rl_confidence double, tuned_confidence double, confidence_tuner_version int, created_at timestamp"
FEEDBACK = "id string, entity_group_id string, reviewer_id string, is_match_correct boolean, notes string, feedback_timestamp timestamp, processed_for_tuner_update_at timestamp"
SUGGESTIONS = "id string, pipeline_run_id string, action_type string, entity_id string, group_id_1 string, group_id_2 string, cluster_id string, triggering_confidence double, details string, reason_code string, reason_message string, priority int, status string, reviewer_id string, reviewed_at timestamp, review_notes string"
FORMATION_EDGES = "pipeline_run_id string, source_group_id string, target_group_id string, calculated_edge_weight double, contributing_shared_entities string"
MODELS = "id string, model_type string, parameters string, metrics string, version int"
JOBS = "id string, service_id string, status string, worker_id string, batch_id string, created_at timestamp, updated_at timestamp, error_message string, retry_count int, last_retry_at timestamp, input_tokens int, truncation_strategy string, metadata string"
WORKERS = "id string, hostname string, ip_address string, worker_type string, capabilities string, status string, last_heartbeat timestamp, current_batch_size int, current_load double, active_jobs int, created_at timestamp"
CAPABILITIES = "max_batch_size int, optimal_batch_size int, embedding_dimensions int, gpu_type string, supports_truncation boolean"

#: Values that status and kind columns may take.
JOB_STATUS = ("queued", "fetched", "tokenized", "processing", "completed", "failed")
OPEN_JOB_STATUS = JOB_STATUS[:4]
WORKER_STATUS = ("online", "offline", "busy", "error")
WORKER_TYPE = ("cpu", "cuda", "metal")
SERVICE_MATCH_STATUS = ("potential", "confirmed", "rejected")
SUGGESTION_STATUS = ("PENDING_REVIEW", "ACCEPTED", "REJECTED", "IMPLEMENTED", "DEFERRED")
ACTION_TYPE = ("REVIEW_ENTITY_IN_GROUP", "SUGGEST_SPLIT_CLUSTER", "SUGGEST_MERGE_GROUPS", "REVIEW_INTER_GROUP_LINK", "REVIEW_LOW_CONFIDENCE_PAIR")
METHODS = ("email", "phone", "url", "address", "name", "geospatial")
