"""tracewarden: security-telemetry analytics and tamper-evident evidence on Spark."""

__version__ = "0.1.0"
