"""Anchoring gate: which alerts are committed at once, batched, or kept off-chain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import severity

IMMEDIATE, BATCH, OFF_CHAIN = "immediate", "batch", "off_chain_only"


@dataclass(frozen=True)
class GatePolicy:
    """A dozen numbers at most, so it is applied as literals rather than joined.

    The fields carry the names of the policy file, so that a file is read by its typed schema
    (``sources.lookups.read_policy``). ``severity_by_threat`` replaces the built-in severities (``severity_of``).
    """

    anchor_attack_only: bool = True
    confidence_threshold: float = 0.0
    immediate_confidence_threshold: float = 0.99
    category_thresholds: dict[str, float] = field(default_factory=dict)
    severity_by_threat: dict[str, str] = field(default_factory=dict)

    def gate_for(self, category: Column) -> Column:
        own = F.lit(self.confidence_threshold)
        for name, value in self.category_thresholds.items():
            own = F.when(category == name, F.lit(value)).otherwise(own)
        return own

    def severity_of(self, category: Column, unknown: str | None = "UNKNOWN") -> Column:
        """Severity by the policy's own table if it has one, else by the built-in table."""
        return severity(category, unknown, self.severity_by_threat or None)

    def decide(self, verdict: Column, category: Column, confidence: Column) -> Column:
        """A confidence that is null or NaN says nothing, so such an event stays off-chain."""
        keep_off = ~known(confidence) | (confidence < self.gate_for(category))
        if self.anchor_attack_only:
            keep_off = (verdict != "ATTACK") | keep_off
        return (
            F.when(F.coalesce(keep_off, F.lit(True)), OFF_CHAIN)
            .when(confidence >= self.immediate_confidence_threshold, IMMEDIATE).otherwise(BATCH)
        )


def known(confidence: Column) -> Column:
    return confidence.isNotNull() & ~F.isnan(confidence)


def follow_source(anchor: Column, severity: Column) -> Column:
    """Keep the producer's flag; only the urgency comes from severity. A missing flag stays off-chain."""
    return F.when(F.coalesce(~anchor, F.lit(True)), OFF_CHAIN).when(severity == "critical", IMMEDIATE).otherwise(BATCH)


def anchor_flag(confidence: Column, tau: float) -> Column:
    """Inclusive, and taken before the confidence is rounded for the alert; false for null and NaN."""
    return known(confidence) & (confidence >= F.lit(float(tau)))


def anchor_lookup(events: DataFrame, flags: DataFrame, key: str = "event_id") -> DataFrame:
    return events.join(flags, key)
