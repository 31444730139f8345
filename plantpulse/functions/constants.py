"""Fixed values of the message contracts: stated as they are on the wire."""

# Device channels and the log topic each one is forwarded to.
CHANNEL_TOPICS = {
    "telemetry": "raw.telemetry",
    "event": "raw.events",
    "alarm": "raw.alarms",
    "state": "asset.state",
    "command/request": "command.request",
    "command/ack": "command.ack",
}

# The topics that are folded into tables.
INGEST_TOPICS = [
    "raw.telemetry",
    "raw.alarms",
    "raw.events",
    "asset.state",
    "command.request",
    "command.ack",
    "analytics.inference",
]

# The topic that carries rolling features, and the device topic filter.
FEATURE_TOPIC = "analytics.features"
DEVICE_TOPIC_FILTER = "site/+/area/+/asset/+/#"

# Enumerations of the contracts.
QUALITY_LEVELS = ["good", "uncertain", "bad"]
SAMPLING_CLASSES = ["subsecond", "1s", "5s", "15s", "60s", "300s"]
COMMAND_PRIORITIES = ["low", "medium", "high", "critical"]
APPROVAL_STATES = ["draft", "approved", "rejected"]

# Limits above which a signal raises an alarm.
DEFAULT_THRESHOLDS = {"bearing_temp": 82.0, "vibration_rms": 4.5, "h2s_ppm": 7.0}

# Anomaly scoring defaults.
WINDOW_LENGTH = 32
BOTTLENECK = 8
DEFAULT_MODEL_ID = "vibration-anomaly"
DEFAULT_SCORE_THRESHOLD = 0.15

# Page sizes of the read models.
TELEMETRY_LIMIT = 500
TELEMETRY_LIMIT_MAX = 5000
ALARM_LIST_LIMIT = 200
PENDING_LIMIT = 250
ERROR_TEXT_LIMIT = 400

# Headers a command must carry to pass the publish policy.
COMMAND_POLICY_FIELDS = ["commandId", "siteId", "assetId", "approvalReference", "expiresAt"]

# A command without acknowledgement is overdue after this many seconds.
COMMAND_ACK_TIMEOUT_SECONDS = 90

# Rollup widths, and how far back and how close to now a refresh reaches.
ROLLUPS = {
    "1m": {"width": "1 minute", "start": "2 days", "end": "1 minute"},
    "15m": {"width": "15 minutes", "start": "14 days", "end": "15 minutes"},
    "1h": {"width": "1 hour", "start": "90 days", "end": "1 hour"},
}
RETENTION_MONTHS = 13
