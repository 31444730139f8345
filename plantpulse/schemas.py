"""Fixed table schemas, as DDL. Instants are TIMESTAMP with the session in UTC."""

from __future__ import annotations

# Tables and their columns.
ASSET_REGISTRY = "asset_id string, site_id string, area_id string, name string, protocol string, created_at timestamp"
SIGNAL_REGISTRY = "asset_id string, signal_id string, unit string, sampling_class string"
MEASUREMENTS = (
    "ts_source timestamp, ts_ingest timestamp, event_id string, site_id string, asset_id string, signal_id string, "
    "seq bigint, quality string, unit string, value double, tags string, trace_id string"
)
EVENTS = "ts_source timestamp, event_id string, site_id string, asset_id string, event_type string, payload string"
ALARMS = (
    "raised_at timestamp, alarm_id string, site_id string, asset_id string, severity string, message string, "
    "state string, acknowledged_at timestamp, payload string"
)
COMMAND_LOG = (
    "issued_at timestamp, command_id string, site_id string, asset_id string, target_signal string, "
    "requested_value string, requested_by string, priority string, approved boolean, approval_reference string, "
    "expires_at timestamp, status string"
)
ASSET_STATE = "ts_source timestamp, site_id string, asset_id string, state string, payload string"
MODEL_REGISTRY = (
    "deployed_at timestamp, model_id string, version string, checksum string, input_schema string, "
    "approval_state string, target_scope string, rollback_version string, deployed_by string"
)
MODEL_SCORES = (
    "ts_source timestamp, model_id string, site_id string, asset_id string, signal_id string, score double, "
    "anomalous boolean, payload string"
)
SITE_HEALTH = (
    "updated_at timestamp, site_id string, site_name string, status string, connected boolean, mqtt_connected boolean, "
    "spool_depth int, kafka_lag int"
)
SPOOL = (
    "row_id bigint, site_id string, kafka_topic string, message_key string, payload string, status string, "
    "attempts int, last_error string, created_at timestamp, sent_at timestamp"
)
SCORE_WINDOW = (
    "window array<double>, model_id string, site_id string, asset_id string, signal_id string, ts_source timestamp, "
    "threshold double"
)

TABLES = {
    "measurements": MEASUREMENTS,
    "events": EVENTS,
    "alarms": ALARMS,
    "command_log": COMMAND_LOG,
    "asset_state": ASSET_STATE,
    "model_scores": MODEL_SCORES,
}
