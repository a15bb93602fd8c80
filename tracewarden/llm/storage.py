"""Written tables that cut lineage, in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts that cross to Python in one batch.
TEXT_ROWS = 2500


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session short, since their rows hold whole texts.

    A batch stands in the JVM, in the worker and in copies on either side at once, for every running task.
    """
    now = int(spark.conf.get(ARROW_ROWS))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{configured.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back.

    Later branches read the table instead of repeating the work, and a lost executor costs a read.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
