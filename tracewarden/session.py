"""Session construction and the checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "tracewarden", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session for local work; on a cluster pass no master and let spark-submit decide.

    Shuffle parallelism is left to AQE: the initial partition count is only an upper bound that
    AQE coalesces, so a cluster job raises it with ``conf`` and small runs lose nothing.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        cores = "".join(ch for ch in master if ch.isdigit()) or str(os.cpu_count() or 4)
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", cores)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only where neither that nor a
    directory set on the context exists (tests, laptops) is a local one created.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="tracewarden-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured
