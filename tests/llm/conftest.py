import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def alert_texts(spark, data):
    """Alerts of the project with their canonical string, class and resource."""
    from tracewarden.functions.digests import alert_canonical_string
    from tracewarden.plans import bindings

    alerts = bindings.alerts(spark, data).withColumn("canonical_string", alert_canonical_string())
    return alerts.select("event_id", "canonical_string", "cloud_resource_id", "threat_class", "features").orderBy(F.col("event_id")).limit(300)
