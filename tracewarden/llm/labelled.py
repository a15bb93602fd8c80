"""Bounded, class-balanced samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    events: DataFrame, labels: DataFrame, label: str, rows_per_class: int, event_id: str = "event_id",
    canonical_string: str = "canonical_string", where: Column | None = None, seed: int = 5,
) -> DataFrame:
    """Texts with a label of 0 or 1: ``event_id``, ``text``, ``label``, ``weight``, ``fold`` (0 to 4).

    Of each class about ``rows_per_class`` rows are drawn by a seeded hash of the id (all, if there are
    fewer); ``weight`` is the inverse of the class's share, so that weighted figures stand for all
    labelled rows. ``where`` is a condition on the ``event_id`` of ``labels``. Several labels of one id
    are averaged, and of several texts of one id the one with the smallest hash counts, so the bound holds for rows. The drawn ids are few by construction, so they are broadcast to the texts.
    """
    rated = labels.where(F.col(label).isin(0, 1) & F.col(event_id).isNotNull())
    rated = rated.where(where) if where is not None else rated
    rated = rated.groupBy(F.col(event_id).alias("event_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in rated.groupBy("label").count().collect()}
    share = {k: min(1.0, rows_per_class / n) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.when(F.col("label") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0)))
    drawn = rated.where(draw < keep).withColumns({
        "weight": 1.0 / keep, "fold": F.pmod(F.xxhash64("event_id", F.lit(seed + 1)), F.lit(5)).cast("int")})
    texts = events.select(F.col(event_id).alias("event_id"), F.coalesce(F.col(canonical_string).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "event_id").groupBy("event_id", "label", "weight", "fold")
    return rows.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("event_id", "text", "label", "weight", "fold")
