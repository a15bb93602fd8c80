"""Saved models with a one-row card that identifies them."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import with_canonical_json
from .files import directory_digest, file_digests


def export_model(
    spark: SparkSession, model: Transformer, path: str, features: list[str], labels: list[str],
    thresholds: dict[str, float], hyperparameters: dict[str, str] | None = None,
) -> DataFrame:
    """Write model and card; returns the card. The digest covers everything that changes a prediction."""
    stage = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    stage.write().overwrite().save(f"{path}/model")
    files = file_digests(spark, f"{path}/model", "*").where(F.col("path").rlike("(part-|metadata)") & ~F.col("path").endswith(".crc"))
    artifact = directory_digest(files).first()["digest"]
    card = model_card(spark, artifact, features, labels, thresholds, hyperparameters or {})
    card.coalesce(1).write.mode("overwrite").parquet(f"{path}/card")
    return spark.read.parquet(f"{path}/card")


def model_card(
    spark: SparkSession, artifact: str, features: list[str], labels: list[str], thresholds: dict[str, float],
    hyperparameters: dict[str, str],
) -> DataFrame:
    schema = (
        "artifact_sha256 string, feature_order array<string>, label_order array<string>, "
        "hyperparameters map<string,string>, thresholds map<string,double>"
    )
    row = spark.createDataFrame([(artifact, features, labels, hyperparameters, thresholds)], schema)
    packed = with_canonical_json(row.withColumn("c", F.struct("*")), "c", "_text")
    return packed.withColumn("model_digest", F.sha2("_text", 256)).drop("c", "_text")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/card")
