"""Small lookup tables: severity map, policy, model card and metric tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import SEVERITY
from ..operators.gate import GatePolicy


def severity_table(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((mapping or SEVERITY).items()), "category string, severity string")


POLICY = T.StructType([
    T.StructField("anchor_attack_only", T.BooleanType()),
    T.StructField("confidence_threshold", T.DoubleType()),
    T.StructField("immediate_confidence_threshold", T.DoubleType()),
    T.StructField("category_thresholds", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("severity_by_threat", T.MapType(T.StringType(), T.StringType())),
])


def read_policy(spark: SparkSession, path: str) -> GatePolicy:
    """Gate policy from a JSON or YAML file (one object). Members that are absent keep their default."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    if path.endswith((".yaml", ".yml")):
        text = json.dumps(_yaml(text))
    row = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", POLICY, {"mode": "FAILFAST"}).alias("p")).first()
    return GatePolicy(**{k: v for k, v in row["p"].asDict(recursive=True).items() if v is not None})


def _yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading a YAML policy needs the yaml module") from missing
    return yaml.safe_load(text) or {}


def read_metric_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def read_feature_stats(spark: SparkSession, path: str) -> DataFrame:
    schema = "feature string, median double, p05 double, p95 double, min double, max double"
    return spark.read.schema(schema).csv(path, header=True)


def read_model_card(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).withColumn("card_path", F.lit(path))
