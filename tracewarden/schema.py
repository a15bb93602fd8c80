"""Explicit row shapes and name-based column roles."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from . import constants as K


@dataclass(frozen=True)
class Roles:
    identifiers: list[str]
    labels: list[str]
    features: list[str]


def _named(patterns: list[str]) -> re.Pattern[str]:
    return re.compile("|".join(map(re.escape, patterns)), re.IGNORECASE)


#: Roles by precedence; the last one takes every name.
ROLE_RULES = {"identifiers": _named(K.IDENTIFIER_PATTERNS), "labels": _named(K.LABEL_PATTERNS), "features": re.compile("")}
TIMESTAMP_NAME = _named(K.TIMESTAMP_PATTERNS)


def role_of(column: str) -> str:
    """The first role whose rule finds something in the name."""
    return next(role for role, rule in ROLE_RULES.items() if rule.search(column))


def classify_columns(columns: list[str]) -> Roles:
    """Columns by role, each in their given order."""
    role = {c: role_of(c) for c in columns}
    return Roles(**{name: [c for c in columns if role[c] == name] for name in ROLE_RULES})


def timestamp_columns(columns: list[str]) -> list[str]:
    return list(filter(TIMESTAMP_NAME.search, columns))


def _best_label(labels: list[str], word: str) -> str | None:
    exact = [c for c in labels if c.lower() == word]
    partial = [c for c in labels if word in c.lower()]
    return next(iter(exact + partial), None)


def multiclass_label(labels: list[str]) -> str | None:
    return _best_label(labels, "attack") or next(iter(labels), None)


def binary_label(labels: list[str]) -> str | None:
    return _best_label(labels, "label")


def destination_port(identifiers: list[str]) -> str | None:
    return next((c for c in identifiers if "l4_dst_port" in c.lower()), None)


def truth_column(columns: list[str], coarse: str = "THREAT_CATEGORY") -> tuple[str, str] | None:
    """Which ground truth a scored file carries: (column, kind), coarse before fine before binary."""
    lowered = {c.strip().lower(): c for c in columns}
    for name, kind in ((coarse.lower(), "coarse"), ("attack", "fine"), ("label", "binary")):
        if name in lowered:
            return lowered[name], kind
    return None


ATTRIBUTION = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("shap", T.DoubleType()),
])

ALERT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("threat_class", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.LongType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.LongType()),
    T.StructField("cloud_resource_id", T.StringType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("feature_digest", T.StringType()),
    T.StructField("top_contributing_features", T.ArrayType(ATTRIBUTION)),
    T.StructField("event_hash", T.StringType()),
    T.StructField("anchor", T.BooleanType()),
    T.StructField("anchor_gate_tau", T.DoubleType()),
    T.StructField("inference_latency_ms", T.DoubleType()),
])

EVIDENCE_EVENT = T.StructType([
    T.StructField("contract_version", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("threat_category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("calibrated_confidence", T.DoubleType()),
    T.StructField("calibration", T.StructType([
        T.StructField("is_calibrated", T.BooleanType()),
        T.StructField("method", T.StringType()),
        T.StructField("expected_calibration_error", T.DoubleType()),
    ])),
    T.StructField("source_address", T.StringType()),
    T.StructField("destination_address", T.StringType()),
    T.StructField("resource_id", T.StringType()),
    T.StructField("triggering_features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("model", T.StructType([
        T.StructField("model_id", T.StringType()),
        T.StructField("model_digest", T.StringType()),
        T.StructField("version_label", T.StringType()),
    ])),
    T.StructField("feature_attributions", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()),
        T.StructField("contribution", T.DoubleType()),
    ]))),
    T.StructField("detection_contract", T.StructType([
        T.StructField("producer", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("event_hash", T.StringType()),
        T.StructField("feature_digest", T.StringType()),
        T.StructField("anchor_gate_tau", T.DoubleType()),
        T.StructField("producer_anchor_decision", T.BooleanType()),
        T.StructField("digest_verified_by_consumer", T.BooleanType()),
    ])),
    T.StructField("inference_latency_ms", T.DoubleType()),
    T.StructField("payload_digest", T.StringType()),
])
# members that are left out of the canonical text when null; every other null is written as null
EVIDENCE_OPTIONAL = {
    "calibration.expected_calibration_error", "detection_contract",
    "detection_contract.anchor_gate_tau",
}

COMMITTED_RECORD = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("content_address", T.StringType()),
    T.StructField("resource_id", T.StringType()),
    T.StructField("threat_category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("calibrated_confidence", T.DoubleType()),
    T.StructField("model_digest", T.StringType()),
    T.StructField("agent_id", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("block_number", T.LongType()),
    T.StructField("merkle_root", T.StringType()),
])

PROVENANCE = T.StructType([
    T.StructField("contract_version", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("model_digest", T.StringType()),
    T.StructField("version_label", T.StringType()),
    T.StructField("artifact_content_address", T.StringType()),
    T.StructField("feature_order", T.ArrayType(T.StringType())),
    T.StructField("label_order", T.ArrayType(T.StringType())),
    T.StructField("hyperparameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("thresholds", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("anchored_at", T.StringType()),
])
