"""Message contracts: rules and typed fields of the four envelopes.

Each contract offers its rules (a list evaluated first-failure-first) and its typed
columns, both over a parsed ``Payload``. Two modes exist. ``lenient`` fills defaults and
ignores unknown keys; ``strict`` also demands the optional envelope fields, rejects
unknown keys and checks JSON types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    APPROVAL_STATES,
    COMMAND_PRIORITIES,
    QUALITY_LEVELS,
    SAMPLING_CLASSES,
)
from ..functions.payload import NUMBER, RAW, TEXT, TIME, WHOLE, Payload, is_number_kind, with_payload
from ..functions import rules as R
from ..functions.rules import MALFORMED, Rule, first_failure, rule, with_failure

LENIENT = "lenient"
STRICT = "strict"

# Keys each contract requires and allows, as they are on the wire.
TELEMETRY_REQUIRED = ["eventId", "siteId", "assetId", "signalId", "quality", "ts_source", "ts_ingest", "seq", "value"]
TELEMETRY_STRICT = ["unit"]
TELEMETRY_OPTIONAL = ["unit", "tags", "traceId"]
COMMAND_REQUIRED = ["commandId", "siteId", "assetId", "targetSignal", "requestedValue", "requestedBy", "expiresAt"]
COMMAND_STRICT = ["priority"]
COMMAND_OPTIONAL = ["priority", "approved", "approvalReference"]
DEVICE_REQUIRED = ["siteId", "assetId", "deviceId", "protocol", "signalMap", "units", "samplingClass"]
DEVICE_OPTIONAL = ["thresholds", "ownershipTags"]
MODEL_REQUIRED = ["modelId", "version", "checksum", "inputSchema", "approvalState", "targetScope"]
MODEL_OPTIONAL = ["rollbackVersion"]


# --- shared rules ---------------------------------------------------------------------


def payload_rules(p: Payload) -> list[Rule]:
    return [
        rule(~p.is_json(), R.NOT_JSON),
        rule(~p.is_object(), R.NOT_OBJECT, MALFORMED),
    ]


def _missing(p: Payload, names: list[str]) -> list[Rule]:
    return [rule(~p.present(n), R.ABSENT.format(n)) for n in names]


def _required_text(p: Payload, names: dict[str, str]) -> list[Rule]:
    """JSON null counts as empty."""
    return [rule(F.coalesce(p.text(key), F.lit("")) == "", R.EMPTY.format(label)) for key, label in names.items()]


def _one_of(value: Column, allowed: list[str], label: str) -> Rule:
    return rule(~F.coalesce(value.isin(*allowed), F.lit(False)), R.UNKNOWN_VALUE.format(label))


def _timestamp_rule(p: Payload, name: str) -> Rule:
    shown = F.coalesce(p.text(name), F.lit("null"))
    return rule(p.time(name).isNull(), F.concat(F.lit(R.BAD_TIME), shown))


def _object_if_present(p: Payload, name: str) -> Rule:
    return rule(p.present(name) & ~p.kind(name).startswith("OBJECT"), f"{name} is not an object", MALFORMED)


def _strict_keys(p: Payload, required: list[str], allowed: list[str]) -> list[Rule]:
    keys = F.map_keys(F.try_variant_get(F.col(p.body), "$", "map<string,variant>"))
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(x) for x in allowed])))
    return _missing(p, required) + [
        rule(F.size(unknown) > 0, F.concat(F.lit("unknown key: "), F.get(unknown, F.lit(0)))),
    ]


def _typed(p: Payload, names: list[str], wanted: str) -> list[Rule]:
    """Strict type check on fields that are present; ``wanted`` is the name used in messages."""
    out = []
    for name in names:
        type_of = p.kind(name)
        ok = {
            "string": type_of == "STRING",
            "boolean": type_of == "BOOLEAN",
            "object": type_of.startswith("OBJECT"),
            "integer": p.is_number(name)
            & (p.value(name).try_cast("double") == F.floor(p.value(name).try_cast("double"))),
            "scalar": p.is_number(name) | type_of.isin("STRING", "BOOLEAN"),
        }[wanted]
        out.append(rule(p.present(name) & ~ok, f"{name} must be of type {wanted}"))
    return out


def _map_values(p: Payload, name: str, wanted: str) -> Rule:
    """Every value of an object field has the wanted type."""
    values = F.map_values(p.value(name).try_cast("map<string,variant>"))
    if wanted == "string":
        ok = F.forall(values, lambda v: F.schema_of_variant(v) == "STRING")
    else:
        ok = F.forall(values, lambda v: is_number_kind(F.schema_of_variant(v)))
    return rule(~ok, f"{name} values must be of type {wanted}")


# --- telemetry ------------------------------------------------------------------------


def telemetry_rules(p: Payload, mode: str = LENIENT) -> list[Rule]:
    seq = p.whole_number("seq")
    seq_kind = p.kind("seq")
    rules = payload_rules(p)
    if mode == STRICT:
        rules += _strict_keys(p, TELEMETRY_REQUIRED + TELEMETRY_STRICT, TELEMETRY_REQUIRED + TELEMETRY_OPTIONAL)
        rules += _typed(
            p, ["eventId", "siteId", "assetId", "signalId", "quality", "ts_source", "ts_ingest", "unit", "traceId"], "string"
        )
        rules += _typed(p, ["seq"], "integer") + _typed(p, ["value"], "scalar") + _typed(p, ["tags"], "object")
        rules += [_map_values(p, "tags", "string")]
    rules += _missing(p, TELEMETRY_REQUIRED)
    rules += [
        rule(
            (seq_kind == "VOID") | seq_kind.startswith("OBJECT") | seq_kind.startswith("ARRAY"),
            "seq is not a number", MALFORMED,
        ),
        rule(seq.isNull(), "seq is not a whole number"),
        _object_if_present(p, "tags"),
    ]
    rules += _required_text(
        p, {"eventId": "event_id", "siteId": "site_id", "assetId": "asset_id", "signalId": "signal_id"}
    )
    rules += [
        _one_of(p.text("quality"), QUALITY_LEVELS, "quality"),
        _timestamp_rule(p, "ts_source"),
        _timestamp_rule(p, "ts_ingest"),
        rule(seq < 0, R.BELOW_ZERO.format("seq")),
    ]
    return rules


def value_rules(p: Payload) -> list[Rule]:
    """The extra rules of a measurement: its value has to be numeric."""
    shown = p.text("value")
    type_of = p.kind("value")
    supported = p.is_number("value") | type_of.isin("STRING", "BOOLEAN")
    return [
        rule(~supported, R.VALUE_KIND),
        rule(p.number("value").isNull(), F.concat(F.lit(R.VALUE_TEXT), shown)),
    ]


def telemetry_fields(p: Payload) -> dict[str, Column]:
    empty_tags = F.lit("{}")
    return {
        "event_id": p.text("eventId"),
        "site_id": p.text("siteId"),
        "asset_id": p.text("assetId"),
        "signal_id": p.text("signalId"),
        "quality": p.text("quality"),
        "ts_source": p.time("ts_source"),
        "ts_ingest": p.time("ts_ingest"),
        "seq": p.whole_number("seq"),
        "unit": F.coalesce(p.text("unit"), F.lit("")),
        "value": p.number("value"),
        "tags": F.coalesce(p.canonical("tags"), empty_tags),
        "trace_id": F.coalesce(p.text("traceId"), F.lit("")),
    }


# --- commands -------------------------------------------------------------------------


def command_rules(p: Payload, mode: str = LENIENT) -> list[Rule]:
    priority = F.when(p.present("priority"), p.text("priority")).otherwise(F.lit("medium"))
    reference = F.coalesce(p.text("approvalReference"), F.lit(""))
    rules = payload_rules(p)
    if mode == STRICT:
        rules += _strict_keys(p, COMMAND_REQUIRED + COMMAND_STRICT, COMMAND_REQUIRED + COMMAND_OPTIONAL)
        rules += _typed(
            p,
            ["commandId", "siteId", "assetId", "targetSignal", "requestedBy", "priority", "approvalReference", "expiresAt"],
            "string",
        )
        rules += _typed(p, ["approved"], "boolean") + _typed(p, ["requestedValue"], "scalar")
    rules += _missing(p, COMMAND_REQUIRED)
    rules += _required_text(
        p,
        {
            "commandId": "command_id", "siteId": "site_id", "assetId": "asset_id",
            "targetSignal": "target_signal", "requestedBy": "requested_by",
        },
    )
    # Strict mode ties the reference to an explicit approved=false only.
    not_approved = ~p.truthy("approved")
    if mode == STRICT:
        not_approved = not_approved & p.present("approved")
    rules += [
        _one_of(priority, COMMAND_PRIORITIES, "priority"),
        rule(not_approved & (reference != ""), R.LOOSE_REFERENCE),
        _timestamp_rule(p, "expiresAt"),
    ]
    return rules


def command_fields(p: Payload) -> dict[str, Column]:
    approved = p.truthy("approved")
    return {
        "command_id": p.text("commandId"),
        "site_id": p.text("siteId"),
        "asset_id": p.text("assetId"),
        "target_signal": p.text("targetSignal"),
        "requested_value": F.coalesce(p.display("requestedValue"), F.lit("None")),
        "requested_by": p.text("requestedBy"),
        "priority": F.coalesce(p.text("priority"), F.lit("medium")),
        "approved": approved,
        "approval_reference": F.coalesce(p.text("approvalReference"), F.lit("")),
        "expires_at": p.time("expiresAt"),
        "status": command_status(approved),
    }


def command_status(approved: Column) -> Column:
    return F.when(approved, F.lit("approved")).otherwise(F.lit("pending-approval"))


# --- devices and models ---------------------------------------------------------------


def device_rules(p: Payload, mode: str = LENIENT) -> list[Rule]:
    rules = payload_rules(p)
    if mode == STRICT:
        rules += _strict_keys(p, DEVICE_REQUIRED, DEVICE_REQUIRED + DEVICE_OPTIONAL)
        rules += _typed(p, ["siteId", "assetId", "deviceId", "protocol", "samplingClass"], "string")
        rules += _typed(p, ["signalMap", "units", "thresholds", "ownershipTags"], "object")
        rules += [_map_values(p, n, "string") for n in ("signalMap", "units", "ownershipTags")]
        rules += [_map_values(p, "thresholds", "number")]
    rules += _missing(p, DEVICE_REQUIRED)
    rules += [_object_if_present(p, n) for n in ("signalMap", "units", "thresholds", "ownershipTags")]
    rules += _required_text(
        p, {"siteId": "site_id", "assetId": "asset_id", "deviceId": "device_id", "protocol": "protocol"}
    )
    rules += [
        rule(F.size(_string_map(p, "signalMap")) == 0, R.EMPTY.format("signal_map")),
        _one_of(p.text("samplingClass"), SAMPLING_CLASSES, "sampling_class"),
    ]
    return rules


def _string_map(p: Payload, name: str) -> Column:
    return p.value(name).try_cast("map<string,string>")


def device_fields(p: Payload) -> dict[str, Column]:
    return {
        "site_id": p.text("siteId"),
        "asset_id": p.text("assetId"),
        "device_id": p.text("deviceId"),
        "protocol": p.text("protocol"),
        "signal_map": _string_map(p, "signalMap"),
        "units": _string_map(p, "units"),
        "sampling_class": p.text("samplingClass"),
        "thresholds": F.coalesce(
            p.value("thresholds").try_cast("map<string,double>"), F.create_map().cast("map<string,double>")
        ),
        "ownership_tags": F.coalesce(_string_map(p, "ownershipTags"), F.create_map().cast("map<string,string>")),
    }


def model_rules(p: Payload, mode: str = LENIENT) -> list[Rule]:
    rules = payload_rules(p)
    if mode == STRICT:
        rules += _strict_keys(p, MODEL_REQUIRED, MODEL_REQUIRED + MODEL_OPTIONAL)
        rules += _typed(p, MODEL_REQUIRED + MODEL_OPTIONAL, "string")
    rules += _missing(p, MODEL_REQUIRED)
    rules += _required_text(
        p,
        {"modelId": "model_id", "version": "version", "checksum": "checksum", "inputSchema": "input_schema"},
    )
    rules += [_one_of(p.text("approvalState"), APPROVAL_STATES, "approval_state")]
    rules += _required_text(p, {"targetScope": "target_scope"})
    return rules


def model_fields(p: Payload) -> dict[str, Column]:
    return {
        "model_id": p.text("modelId"),
        "version": p.text("version"),
        "checksum": p.text("checksum"),
        "input_schema": p.text("inputSchema"),
        "approval_state": p.text("approvalState"),
        "target_scope": p.text("targetScope"),
        "rollback_version": F.coalesce(p.text("rollbackVersion"), F.lit("")),
    }


def reads(names: list[str], times: tuple[str, ...] = (), raw: tuple[str, ...] = (), **others: str) -> dict[str, str]:
    """How each key of a contract is read; text unless said otherwise."""
    special = {**dict.fromkeys(times, TIME), **dict.fromkeys(raw, RAW), **others}
    return {n: special.get(n, TEXT) for n in names}


TELEMETRY_READS = reads(
    TELEMETRY_REQUIRED + TELEMETRY_OPTIONAL, ("ts_source", "ts_ingest"), ("tags",), seq=WHOLE, value=NUMBER
)
COMMAND_READS = reads(COMMAND_REQUIRED + COMMAND_OPTIONAL, ("expiresAt",))
DEVICE_READS = reads(DEVICE_REQUIRED + DEVICE_OPTIONAL, (), ("signalMap", "units", "thresholds", "ownershipTags"))
MODEL_READS = reads(MODEL_REQUIRED + MODEL_OPTIONAL)

# contract -> (rules, typed fields, keys the rules and fields look at)
CONTRACTS = {
    "telemetry": (telemetry_rules, telemetry_fields, TELEMETRY_READS),
    "command": (command_rules, command_fields, COMMAND_READS),
    "device": (device_rules, device_fields, DEVICE_READS),
    "model": (model_rules, model_fields, MODEL_READS),
}


def validate(messages: DataFrame, contract: str, mode: str = LENIENT, raw: str = "raw") -> DataFrame:
    """Add the typed fields of a contract and ``reason``/``error`` to rows of JSON text.

    Fields of a row that fails are NULL, so nothing half-parsed is read by mistake.
    """
    if mode not in (LENIENT, STRICT):
        raise ValueError(f"mode must be {LENIENT} or {STRICT}")
    rules, fields, wanted = CONTRACTS[contract]
    p = Payload("_raw", "_body", "_fields", "_typed")
    parsed = with_payload(messages, F.col(raw), wanted, p)
    checked = with_failure(parsed, first_failure(rules(p, mode)))
    ok = F.col("failure").isNull()
    return checked.select(
        *messages.columns,
        *[F.when(ok, column).alias(name) for name, column in fields(p).items()],
        F.col("failure.reason").alias("reason"),
        F.col("failure.error").alias("error"),
    )
