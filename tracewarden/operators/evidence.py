"""Alerts, evidence events, their validation and their committed projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .. import schema as S
from ..functions.canonical import with_canonical_json, with_payload_digest
from ..functions.digests import (
    HEX64, alert_canonical_string, content_address, feature_digest, format_address, resource_id, sha256_hex,
)
from ..functions.vectors import top_by_magnitude
from .cleaning import literal_map, severity, translate_severity, verdict
from .distributed import pin
from .gate import anchor_flag

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def build_alerts(
    scored: DataFrame, tau: float, model_version: Column, event_id: Column, timestamp: Column,
    category: str = "threat_class", confidence: str = "confidence", features: str = "features",
    latency_ms: Column | None = None, attributions: str | None = None, carry: list[str] | None = None,
) -> DataFrame:
    """Scored rows to producer alerts, all as one projection (no shuffle).

    Needs columns for the class, confidence, a feature map, and src/dst address and port. ``carry``
    names input columns to keep beside the alert.
    """
    conf = F.col(confidence)
    rounded = F.transform_values(F.col(features), lambda _, v: F.round(v, 6))
    top = F.lit(None).cast(T.ArrayType(S.ATTRIBUTION))
    if attributions:
        top = F.transform(
            top_by_magnitude(F.col(attributions), "shap", K.TOP_ATTRIBUTIONS),
            lambda a: F.struct(a["feature"].alias("feature"), F.round(a["value"], 6).alias("value"),
                               F.round(a["shap"], 6).alias("shap")),
        )
    alerts = scored.select(
        event_id.alias("event_id"), F.lit(K.ALERT_SCHEMA_VERSION).alias("schema_version"),
        timestamp.alias("timestamp"), verdict(F.col(category)).alias("verdict"),
        F.col(category).alias("threat_class"), severity(F.col(category), None).alias("severity"),
        F.round(conf, 6).alias("confidence"), model_version.alias("model_version"),
        "src_ip", F.col("src_port").cast("long").alias("src_port"),
        "dst_ip", F.col("dst_port").cast("long").alias("dst_port"),
        resource_id(F.col("dst_ip")).alias("cloud_resource_id"), rounded.alias("features"),
        top.alias("top_contributing_features"), anchor_flag(conf, tau).alias("anchor"),
        F.round(F.lit(float(tau)), 6).alias("anchor_gate_tau"),
        F.round(latency_ms if latency_ms is not None else F.lit(0.0), 4).alias("inference_latency_ms"),
        *(carry or []),
    )
    alerts = alerts.withColumn("feature_digest", feature_digest(F.col("features")))
    return alerts.withColumn("event_hash", sha256_hex(alert_canonical_string())).select(
        *S.ALERT.fieldNames(), *(carry or [])
    )


def committed_projection(alerts: DataFrame) -> DataFrame:
    return alerts.select(*K.COMMITTED_FIELDS)


def offchain_projection(alerts: DataFrame) -> DataFrame:
    return alerts.select(*K.OFFCHAIN_FIELDS)


# --- validation --------------------------------------------------------------------------------
def _codes(rules: dict[str, Column]) -> Column:
    """Names of the rules that fire. A rule that evaluates to null did not fire."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def alert_violations(known_features: list[str] | None = None) -> Column:
    """Contract and semantic violations of an alert row; an empty array means valid.

    A malformed row yields codes instead of failing the job, so rejects can be counted and kept.
    """
    c = F.col
    required = [
        "event_id", "schema_version", "timestamp", "verdict", "threat_class", "severity", "confidence",
        "model_version", "feature_digest", "event_hash", "anchor", "inference_latency_ms",
    ]
    rules = {f"missing:{name}": c(name).isNull() for name in required}
    port = lambda p: (c(p) < 0) | (c(p) > 65535)
    rules |= {
        "format:event_id": ~c("event_id").rlike(UUID),
        "format:timestamp": ~c("timestamp").rlike(RFC3339),
        "const:schema_version": c("schema_version") != K.ALERT_SCHEMA_VERSION,
        "enum:verdict": ~c("verdict").isin("ANOMALY", "NORMAL"),
        "enum:threat_class": ~c("threat_class").isin(*K.CATEGORIES),
        "enum:severity": ~c("severity").isin(*K.SEVERITY_TRANSLATION),
        "range:confidence": (c("confidence") < 0) | (c("confidence") > 1) | F.isnan("confidence"),
        "range:src_port": port("src_port"), "range:dst_port": port("dst_port"),
        "range:inference_latency_ms": c("inference_latency_ms") < 0,
        "pattern:feature_digest": ~c("feature_digest").rlike(HEX64),
        "pattern:event_hash": ~c("event_hash").rlike(HEX64),
        "length:top_contributing_features": F.size("top_contributing_features") > K.TOP_ATTRIBUTIONS,
        "empty:features": F.coalesce(F.size("features") < 1, F.lit(True)),
        "digest:features": c("feature_digest") != feature_digest(c("features")),
        "digest:event": c("event_hash") != sha256_hex(alert_canonical_string()),
        "consistency:verdict": (c("verdict") == "NORMAL") != (c("threat_class") == "Benign"),
    }
    if known_features:
        allowed = F.array(*[F.lit(f) for f in known_features])
        rules["enum:features"] = F.size(F.array_except(F.map_keys("features"), allowed)) > 0
    return _codes(rules)


def event_violations() -> Column:
    """Violations of an evidence event held in struct column ``event``."""
    c = lambda name: F.col("event")[name]
    optional = {"source_address", "destination_address"}
    rules = {f"missing:{f.name}": c(f.name).isNull() for f in S.EVIDENCE_EVENT.fields if f.name not in optional}
    rules |= {
        "const:contract_version": c("contract_version") != K.EVENT_CONTRACT_VERSION,
        "format:event_id": ~c("event_id").rlike(UUID),
        "format:timestamp": ~c("timestamp").rlike(RFC3339),
        "enum:verdict": ~c("verdict").isin("ATTACK", "BENIGN"),
        "enum:threat_category": ~c("threat_category").isin(*K.CATEGORIES),
        "enum:severity": ~c("severity").isin(*K.SEVERITY_TRANSLATION.values()),
        "range:calibrated_confidence": (c("calibrated_confidence") < 0) | (c("calibrated_confidence") > 1),
        "enum:calibration": ~c("calibration")["method"].isin("isotonic", "platt", "none"),
        "empty:triggering_features": F.size(c("triggering_features")) < 1,
        "pattern:payload_digest": ~c("payload_digest").rlike(HEX64),
        "pattern:model_digest": ~c("model")["model_digest"].rlike(HEX64),
        "range:inference_latency_ms": c("inference_latency_ms") < 0,
    }
    return _codes(rules)


def unknown_members(text: Column, shape: T.StructType) -> Column:
    """Codes of the members of a JSON text that a closed ``shape`` does not have, at any depth of it.

    The text is read as VARIANT and its own members are walked, since a typed read drops what it does not know. A member is
    named by its path (``model.color``, ``feature_attributions[].rank``). Maps are open: their keys are data. A text that is
    no JSON object has no members here; its other violations are told by the typed read.
    """
    value = F.try_parse_json(text)

    def coded(path: tuple[str, ...], at: str, names: list[str]) -> Column:
        others = F.array_except(_member_names(value, path), F.array(*[F.lit(n) for n in names]))
        return F.transform(others, lambda n: F.concat(F.lit(f"unknown:{at}"), n))

    codes = [coded(*found) for found in _objects(shape)]
    return F.array_sort(F.flatten(F.array(*codes)))


def _objects(shape: T.StructType, path: tuple[str, ...] = (), at: str = "") -> list[tuple[tuple[str, ...], str, list[str]]]:
    """Every object of a shape: its path, where ``[]`` opens an array, the text of the path, and its members."""
    found = [(path, at, shape.fieldNames())]
    for field in shape.fields:
        kind, name = field.dataType, f"{at}{field.name}"
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            found += _objects(kind.elementType, (*path, field.name, "[]"), f"{name}[].")
        elif isinstance(kind, T.StructType):
            found += _objects(kind, (*path, field.name), f"{name}.")
    return found


def _member_names(value: Column, path: tuple[str, ...]) -> Column:
    """Distinct member names of the objects at a path; none where the value there is something else."""
    none = F.array().cast("array<string>")
    if "[]" not in path:
        place = "$" + "".join(f".{p}" for p in path)
        return F.coalesce(F.map_keys(F.try_variant_get(value, place, "map<string,variant>")), none)
    cut = path.index("[]")
    place = "$" + "".join(f".{p}" for p in path[:cut])
    items = F.coalesce(F.try_variant_get(value, place, "array<variant>"), F.array().cast("array<variant>"))
    return F.array_distinct(F.flatten(F.transform(items, lambda v: _member_names(v, path[cut + 1:]))))


def split_valid(df: DataFrame, codes: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with their codes)."""
    marked = pin(df.withColumn("violations", codes))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


# --- evidence events ---------------------------------------------------------------------------
def build_events(
    alerts: DataFrame, model_id: Column, model_digest: Column, producer: str, method: str = "isotonic",
    calibration_error: float | None = None, verified: bool = True, floats: str = "six",
) -> DataFrame:
    """Adapt alerts into evidence events: adds struct ``event`` with its payload digest.

    Severity is only renamed, never derived again; an uncalibrated score carries no calibration
    error. ``floats="six"`` relies on alert numbers being rounded to six places, as the contract
    requires; use ``"exact"`` when a calibration error with more digits is attached.
    """
    c = F.col
    ece = None if method == "none" else calibration_error
    if ece is not None and round(ece, 6) != ece:
        floats = "exact"
    # Everything non-trivial becomes a plain column first. Inside a struct, Catalyst would inline an
    # expression at each place its member is read, and the digest text reads every member.
    flat = alerts.withColumns({
        "_verdict": F.element_at(literal_map(K.VERDICT_TRANSLATION), verdict(c("threat_class"))),
        "_severity": translate_severity(c("severity")),
        "_source": format_address(c("src_ip"), c("src_port")),
        "_destination": format_address(c("dst_ip"), c("dst_port")),
        "_resource": F.coalesce(c("cloud_resource_id"), F.lit(K.UNMAPPED_RESOURCE)),
        "_model_id": model_id, "_model_digest": model_digest,
        "_anchor": F.coalesce("anchor", F.lit(False)),
        "_attributions": F.transform(
            F.coalesce(c("top_contributing_features"), F.array().cast(T.ArrayType(S.ATTRIBUTION))),
            lambda a: F.struct(a["feature"].alias("feature"), a["shap"].alias("contribution")),
        ),
    })
    members = [
        F.lit(K.EVENT_CONTRACT_VERSION).alias("contract_version"), c("event_id"), c("timestamp"),
        c("_verdict").alias("verdict"), c("threat_class").alias("threat_category"), c("_severity").alias("severity"),
        c("confidence").alias("calibrated_confidence"),
        F.struct(
            F.lit(method != "none").alias("is_calibrated"), F.lit(method).alias("method"),
            F.lit(ece).cast("double").alias("expected_calibration_error"),
        ).alias("calibration"),
        c("_source").alias("source_address"), c("_destination").alias("destination_address"),
        c("_resource").alias("resource_id"), c("features").alias("triggering_features"),
        F.struct(
            c("_model_id").alias("model_id"), c("_model_digest").alias("model_digest"), c("model_version").alias("version_label"),
        ).alias("model"),
        c("_attributions").alias("feature_attributions"),
        F.struct(
            F.lit(producer).alias("producer"), c("schema_version"), c("event_hash"), c("feature_digest"),
            c("anchor_gate_tau"), c("_anchor").alias("producer_anchor_decision"),
            F.lit(verified).alias("digest_verified_by_consumer"),
        ).alias("detection_contract"),
        c("inference_latency_ms"),
    ]
    built = with_payload_digest(flat.withColumn("event", F.struct(*members)), "event", "_digest", S.EVIDENCE_OPTIONAL, floats)
    whole = F.struct(*members, c("_digest").alias("payload_digest"))
    return built.withColumn("event", whole).select(*alerts.columns, "event")


def with_recomputed_digest(df: DataFrame, source: str = "event", out: str = "recomputed_digest", floats: str = "six") -> DataFrame:
    return with_payload_digest(df, source, out, S.EVIDENCE_OPTIONAL, floats)


def with_stored_payload(df: DataFrame, source: str = "event", floats: str = "six") -> DataFrame:
    """Add payload text, its content address and size. The address covers the stored bytes, which are
    written with blanks after separators and so never equal the text behind the payload digest."""
    df = with_canonical_json(df, source, "payload", S.EVIDENCE_OPTIONAL, floats=floats, spaced=True)
    return df.withColumns({
        "content_address": content_address(F.col("payload")), "size_bytes": F.octet_length("payload").cast("long"),
    })


def committed_records(df: DataFrame, agent: Column, signature: Column, merkle_root: Column | None = None,
                      carry: list[str] | None = None) -> DataFrame:
    """Committed record of each event; needs ``event`` and ``content_address``. ``carry`` names
    columns to keep beside it."""
    e = F.col("event")
    return df.select(
        e["event_id"].alias("event_id"), e["payload_digest"].alias("payload_digest"), "content_address",
        e["resource_id"].alias("resource_id"), e["threat_category"].alias("threat_category"),
        e["severity"].alias("severity"), e["calibrated_confidence"].alias("calibrated_confidence"),
        e["model"]["model_digest"].alias("model_digest"), agent.alias("agent_id"), signature.alias("signature"),
        e["timestamp"].alias("timestamp"), F.lit("").alias("transaction_id"),
        F.lit(None).cast("long").alias("block_number"),
        (merkle_root if merkle_root is not None else F.lit(None).cast("string")).alias("merkle_root"), *(carry or []),
    )
