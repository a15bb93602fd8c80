"""Exact, deterministic sampling by rank of a seeded hash.

A row's rank depends only on its id and the seed, so samples are identical under any partitioning.
The cut-off hash per class is found through a histogram of hash prefixes; the table itself is then
filtered in place, without sorting or shuffling it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BENIGN_KEEP_FRACTION, SEED
from ..functions.digests import alert_canonical_string, hash_rank_key, sha256_hex, uuid5
from .distributed import HASH_BUCKET_CHARS, null_safe_join, row_positions, value_at_positions


def sample_by_quota(
    df: DataFrame, row_id: str, quotas: DataFrame, by: list[str] | None = None, seed: int = SEED,
    prefix: int = HASH_BUCKET_CHARS,
) -> DataFrame:
    """Keep the ``quota`` rows with the lowest hash in each group (all rows of a smaller group).

    ``quotas`` is (by..., n, quota), one row per class. Ids must be unique. Groups without a quota
    row are dropped, as are groups with quota 0.
    """
    by = by or []
    hashed = df.withColumn("_hash", hash_rank_key(F.col(row_id), seed))
    targets = quotas.where((F.col("quota") > 0) & (F.col("quota") < F.col("n"))).select(
        *by, (F.col("quota") - 1).cast("long").alias("_target")
    )
    bucket = F.substring("_hash", 1, prefix)
    cuts = value_at_positions(hashed, "_hash", bucket, targets, by).select(*by, F.col("_hash").alias("_cut"))
    if not by:
        whole = quotas.select(F.col("quota") >= F.col("n")).scalar()
        cut = cuts.agg(F.min("_cut")).scalar()
        marked = hashed.withColumn("_all", whole).withColumn("_cut", cut)
        return marked.where(F.col("_all") | (F.col("_hash") <= F.col("_cut"))).drop("_hash", "_all", "_cut")
    limits = null_safe_join(quotas.where(F.col("quota") > 0), cuts, by, "left").select(*by, "_cut")
    marked = null_safe_join(hashed, limits, by)
    return marked.where(F.col("_cut").isNull() | (F.col("_hash") <= F.col("_cut"))).drop("_hash", "_cut")


def _class_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def downsample_benign(
    df: DataFrame, row_id: str, split: str, benign: Column, keep: float = BENIGN_KEEP_FRACTION, seed: int = SEED,
) -> DataFrame:
    """Keep exactly round(n * keep) benign train rows; attacks, val and test stay whole."""
    target = (F.col(split) == "train") & benign
    pool = df.where(target)
    quotas = pool.agg(F.count("*").alias("n")).withColumn("quota", F.bround(F.col("n") * keep).cast("long"))
    kept = sample_by_quota(pool, row_id, quotas, seed=seed)
    return df.where(~F.coalesce(target, F.lit(False))).unionByName(kept)


def stratified_cap(
    df: DataFrame, row_id: str, label: str, total: int, labels: list[str] | None = None, seed: int = SEED
) -> DataFrame:
    """At most ``total // classes`` rows per class. The class count is that of the label list, or of the data."""
    counts = _class_counts(df, [label])
    classes = F.lit(len(labels)) if labels else counts.agg(F.count("*")).scalar()
    quotas = counts.withColumn("quota", F.greatest(F.lit(1), F.floor(F.lit(total) / classes)).cast("long"))
    return sample_by_quota(df, row_id, quotas, [label], seed)


def class_cap(df: DataFrame, row_id: str, label: str, cap: int, seed: int = SEED) -> DataFrame:
    quotas = _class_counts(df, [label]).withColumn("quota", F.lit(cap).cast("long"))
    return sample_by_quota(df, row_id, quotas, [label], seed)


def stratified_prop(df: DataFrame, row_id: str, label: str, total: int, seed: int = SEED) -> DataFrame:
    """Proportional share of ``total`` per class, at least one row."""
    counts = _class_counts(df, [label])
    all_rows = counts.agg(F.sum("n")).scalar()
    share = F.bround(F.col("n") * F.lit(total) / all_rows).cast("long")
    quotas = counts.withColumn("quota", F.greatest(F.lit(1).cast("long"), share))
    return sample_by_quota(df, row_id, quotas, [label], seed)


def sample_n(df: DataFrame, row_id: str, total: int, seed: int = SEED) -> DataFrame:
    quotas = df.agg(F.count("*").alias("n")).withColumn("quota", F.lit(total).cast("long"))
    return sample_by_quota(df, row_id, quotas, seed=seed)


def quota_plan(counts: dict[str, int], wanted: dict[str, int], benign: str = "Benign") -> dict[str, int]:
    """Final quotas after shortfalls are handed over in turn to the classes with spare rows.

    Works on at most one number per class, whole rounds at a time. Benign never receives a handed-over row.
    """
    quota = {c: min(n, counts.get(c, 0)) for c, n in wanted.items()}
    short = sum(wanted.values()) - sum(quota.values())
    while short > 0:
        spare = [c for c in wanted if c != benign and counts.get(c, 0) > quota[c]]
        if not spare:
            break
        rounds = min(short // len(spare), min(counts[c] - quota[c] for c in spare))
        given = dict.fromkeys(spare, rounds) if rounds else dict.fromkeys(spare[:short], 1)
        quota |= {c: quota[c] + n for c, n in given.items()}
        short -= sum(given.values())
    return quota


def quota_sample(df: DataFrame, row_id: str, label: str, wanted: dict[str, int], seed: int = SEED) -> DataFrame:
    counts = {r[label]: r["n"] for r in _class_counts(df, [label]).collect()}  # one row per class
    plan = quota_plan(counts, wanted)
    rows = [(c, counts.get(c, 0), q) for c, q in plan.items()]
    quotas = df.sparkSession.createDataFrame(rows, f"{label} string, n bigint, quota bigint")
    return sample_by_quota(df, row_id, quotas, [label], seed)


def shuffled(df: DataFrame, row_id: str, seed: int = SEED) -> DataFrame:
    return df.orderBy(hash_rank_key(F.col(row_id), seed))


def _fraction(index: Column, salt: str) -> Column:
    """Deterministic draw in [0, 1) from 32 bits of a salted hash."""
    word = F.substring(sha256_hex(F.concat(index.cast("string"), F.lit(":" + salt))), 1, 8)
    return F.conv(word, 16, 10).cast("double") / 4294967296.0


def replay_resample(
    alerts: DataFrame, order: str, draws: DataFrame, index: str, attack_ratio: float, resources: int,
    seed: int = SEED,
) -> DataFrame:
    """One replayed alert per row of ``draws``: an attack with the given probability, a random member
    of that pool, a new id and one of ``resources`` resource names.

    Class, features and confidence stay the original's; the event hash is computed again, because id
    and resource are inside it. Draws spread evenly over the pool, so the join has no hot key.
    """
    attack = (F.col("verdict") == "ANOMALY").alias("_attack")
    pool = row_positions(alerts.select("*", attack), order, ["_attack"], "_slot")
    counts = pool.groupBy("_attack").agg(F.max("_slot_total").alias("n"))
    sizes = counts.agg(F.map_from_entries(F.collect_list(F.struct("_attack", "n"))).alias("m")).scalar()  # two entries
    i = F.col(index)
    picks = draws.select(i.alias("_index"), (_fraction(i, f"{seed}:class") < attack_ratio).alias("_attack"), sizes.alias("_sizes"))
    slot = F.floor(_fraction(F.col("_index"), f"{seed}:slot") * F.col("_sizes")[F.col("_attack")])
    picks = picks.withColumn("_slot", slot.cast("long")).drop("_sizes")
    joined = picks.join(pool.drop("_slot_total"), ["_attack", "_slot"])
    name = F.concat(F.lit("i-load-"), F.lpad((F.col("_index") % resources).cast("string"), 6, "0"))
    renamed = joined.withColumns({
        "source_event_id": F.col("event_id"), "event_id": uuid5(F.concat(F.lit("replay/"), F.col("_index").cast("string"))),
        "cloud_resource_id": name,
    })
    return renamed.withColumn("event_hash", sha256_hex(alert_canonical_string())).drop("_attack", "_slot").withColumnRenamed("_index", index)
