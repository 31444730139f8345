"""Keyed upserts as one fold.

A key that arrives more than once keeps some columns from its first arrival and takes
others from its last. Both are plain aggregates (``min_by``/``max_by`` over the arrival
order), so copies of one hot key shrink to one row per task before the only shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UpsertSpec:
    """How the arrivals of one table fold into one row per key.

    ``first`` columns keep the first arrival, ``last`` columns take the last one, and
    ``last_known`` columns take the last arrival for which the value is not NULL, with
    the given default when there is none.
    """

    table: str
    keys: list[str]
    first: list[str]
    last: list[str]
    time: str
    last_known: dict[str, object] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.keys + self.first + self.last + list(self.last_known)


MEASUREMENTS = UpsertSpec(
    "measurements",
    keys=["ts_source", "asset_id", "signal_id", "seq"],
    first=["event_id", "site_id"],
    last=["ts_ingest", "quality", "unit", "value", "tags", "trace_id"],
    time="ts_source",
)
ALARMS = UpsertSpec(
    "alarms",
    keys=["raised_at", "alarm_id"],
    first=["site_id", "asset_id", "state", "acknowledged_at"],
    last=["severity", "message", "payload"],
    time="raised_at",
)
EVENTS = UpsertSpec(
    "events", keys=["ts_source", "event_id"], first=["site_id", "asset_id"], last=["payload", "event_type"], time="ts_source"
)
ASSET_STATE = UpsertSpec(
    "asset_state", keys=["ts_source", "asset_id"], first=["site_id"], last=["state", "payload"], time="ts_source"
)
COMMAND_REQUESTS = UpsertSpec(
    "command_log",
    keys=["issued_at", "command_id"],
    first=["site_id", "asset_id", "target_signal", "requested_by", "priority", "expires_at"],
    last=["requested_value", "approved", "approval_reference", "status"],
    time="issued_at",
)
# Requests and acknowledgements together: only a request sets the value and the approval.
COMMAND_LOG = UpsertSpec(
    "command_log",
    keys=["issued_at", "command_id"],
    first=["site_id", "asset_id", "target_signal", "requested_by", "priority", "expires_at"],
    last=["status"],
    time="issued_at",
    last_known={"requested_value": "", "approved": True, "approval_reference": ""},
)
MODEL_SCORES = UpsertSpec(
    "model_scores",
    keys=["ts_source", "model_id", "asset_id", "signal_id"],
    first=["site_id"],
    last=["score", "anomalous", "payload"],
    time="ts_source",
)

SPECS = {s.table: s for s in (MEASUREMENTS, ALARMS, EVENTS, ASSET_STATE, COMMAND_LOG, MODEL_SCORES)}


def fold(arrivals: DataFrame, spec: UpsertSpec, arrival: str | Column = "arrival") -> DataFrame:
    """One row per key. ``arrival`` is any orderable column, unique within a key."""
    order = F.col(arrival) if isinstance(arrival, str) else arrival
    # All first columns travel with one copy of the order, all last columns with another.
    aggregates = [F.min_by(F.struct(*spec.first), order).alias("_first"), F.max_by(F.struct(*spec.last), order).alias("_last")]
    for name, default in spec.last_known.items():
        known = F.max_by(name, F.when(F.col(name).isNotNull(), order))
        aggregates.append(F.coalesce(known, F.lit(default)).alias(name))
    return arrivals.groupBy(*spec.keys).agg(*aggregates).select(*spec.keys, "_first.*", "_last.*", *spec.last_known)


def command_changes(command_rows: DataFrame) -> DataFrame:
    """Request and ack rows ready for COMMAND_LOG: an ack knows no value and no approval."""
    is_request = F.col("kind") == "request"
    known = {name: F.when(is_request, F.col(name)) for name in COMMAND_LOG.last_known}
    return command_rows.withColumns(known).drop("kind")


def merge(stored: DataFrame, arrivals: DataFrame, spec: UpsertSpec, arrival: str = "arrival") -> DataFrame:
    """Fold new arrivals onto stored rows; a stored row counts as the earliest arrival."""
    new = arrivals.select(*spec.columns, F.struct(F.lit(1).alias("age"), F.col(arrival).alias("at")).alias("_order"))
    at_type = arrivals.schema[arrival].dataType
    old_order = F.struct(F.lit(0).alias("age"), F.lit(None).cast(at_type).alias("at"))
    old = stored.select(*spec.columns, old_order.alias("_order"))
    return fold(old.unionByName(new), spec, "_order")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose key is not there yet, one per key: append them."""
    others = [c for c in incoming.columns if c not in keys]
    packed = incoming.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")) if others else incoming.distinct()
    rows = packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])
    return rows.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns)


def new_commands(requests: DataFrame, issued_at: Column) -> DataFrame:
    """Rows to append to the command log: status from the approval, issue time to the second."""
    from .contracts import command_status

    return requests.withColumns(
        {
            "requested_value": F.col("requested_value").cast("string"),
            "status": command_status(F.col("approved")),
            "issued_at": F.date_trunc("second", issued_at),
        }
    )


def new_deployments(deployments: DataFrame, deployed_at: Column, deployed_by: str) -> DataFrame:
    """Rows to append to the model registry: deployment time to the second."""
    return deployments.withColumns(
        {"deployed_at": F.date_trunc("second", deployed_at), "deployed_by": F.lit(deployed_by)}
    )
