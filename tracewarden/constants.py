"""Fixed values of the data contract.

These must equal the published contract for results to agree, so they are stated plainly and kept
together here.
"""

from __future__ import annotations

# --- column roles: case-insensitive substrings -------------------------------------------------
IDENTIFIER_PATTERNS = [
    "ipv4_src_addr", "ipv4_dst_addr", "ipv6_src_addr", "ipv6_dst_addr",
    "l4_src_port", "l4_dst_port", "src_ip", "dst_ip",
]
LABEL_PATTERNS = ["label", "attack"]
TIMESTAMP_PATTERNS = ["flow_start", "flow_end", "first_switched", "last_switched", "timestamp"]
BENIGN_VALUES = ["Benign", "BENIGN", "benign"]

# --- fine label -> coarse category -------------------------------------------------------------
ATTACK_MAP = {
    "Benign": "Benign",
    "DDOS attack-HOIC": "DDoS",
    "DDoS attacks-LOIC-HTTP": "DDoS",
    "DDOS attack-LOIC-UDP": "DDoS",
    "DoS attacks-Hulk": "DoS",
    "DoS attacks-GoldenEye": "DoS",
    "DoS attacks-SlowHTTPTest": "DoS",
    "DoS attacks-Slowloris": "DoS",
    "Bot": "Bot",
    "Infilteration": "Infiltration",
    "SSH-Bruteforce": "BruteForce",
    "FTP-BruteForce": "BruteForce",
    "Brute Force -Web": "Web Attacks",
    "Brute Force -XSS": "Web Attacks",
    "SQL Injection": "Web Attacks",
}
CATEGORIES = ["Benign", "DDoS", "DoS", "Bot", "BruteForce", "Infiltration", "Web Attacks"]

# --- severity and vocabulary ------------------------------------------------------------------
SEVERITY = {
    "Benign": "NONE", "DDoS": "HIGH", "DoS": "HIGH", "Bot": "HIGH",
    "BruteForce": "MEDIUM", "Infiltration": "CRITICAL", "Web Attacks": "HIGH",
}
SEVERITY_TRANSLATION = {
    "NONE": "informational", "LOW": "low", "MEDIUM": "medium", "HIGH": "high",
    "CRITICAL": "critical",
}
VERDICT_TRANSLATION = {"ANOMALY": "ATTACK", "NORMAL": "BENIGN"}

# --- contract fields --------------------------------------------------------------------------
ALERT_SCHEMA_VERSION = "1.0.0"
EVENT_CONTRACT_VERSION = "2.0.0"
DIGEST_FIELDS = [
    "event_id", "schema_version", "timestamp", "verdict", "threat_class", "confidence",
    "model_version", "src_ip", "src_port", "dst_ip", "dst_port", "cloud_resource_id",
    "feature_digest",
]
COMMITTED_FIELDS = [
    "event_id", "event_hash", "timestamp", "threat_class", "severity", "confidence",
    "cloud_resource_id", "model_version",
]
OFFCHAIN_FIELDS = [
    "event_id", "features", "top_contributing_features", "src_ip", "src_port", "dst_ip", "dst_port",
]
UNMAPPED_RESOURCE = "unmapped-resource"
GENESIS_HASH = "0" * 64
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"  # RFC 4122 URL namespace

# --- numeric settings -------------------------------------------------------------------------
OUTLIER_ABS_CUTOFF = 2e13
BENIGN_KEEP_FRACTION = 0.09
SPLIT_FRACTIONS = (0.60, 0.20, 0.20)
CORRELATION_CUTOFF = 0.95
LEAKAGE_F1_CUTOFF = 0.90
SEED = 42
SEARCH_TRIALS = 40
TOP_ATTRIBUTIONS = 5
RELIABILITY_BINS = 15
UNIFORM_TAUS = 201
COVERAGE_TARGETS = [0.999, 0.995, 0.99, 0.98, 0.95, 0.90, 0.80]
THRESHOLD_GRID = [0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0]
RUNNER_UP_MINIMUM = 0.15
ARRIVAL_RATES = [100, 500, 1000, 5000, 10000]
BATCH_FACTORS = [1, 10, 100, 500]
TARGET_TPS = 1000.0
BATCH_SIZE = 100
MAX_ATTEMPTS = 3
BACKOFF_BASE_SEC = 0.05
BACKOFF_MULTIPLIER = 2.0
