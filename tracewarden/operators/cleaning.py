"""Label mapping, masking, coercion, imputation, type narrowing and contract vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ATTACK_MAP, BENIGN_VALUES, OUTLIER_ABS_CUTOFF, SEVERITY, SEVERITY_TRANSLATION
from .distributed import exact_percentiles
from .profile import column_profile


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


# --- labels ------------------------------------------------------------------------------------
def map_labels(df: DataFrame, fine: str, out: str = "category", mapping: dict | None = None) -> DataFrame:
    """Fine label to coarse category. The map is a fixed handful of entries, hence a literal."""
    return df.withColumn(out, F.try_element_at(literal_map(mapping or ATTACK_MAP), F.col(fine)))


def unmapped_labels(df: DataFrame, fine: str, mapping: dict | None = None) -> DataFrame:
    """Labels the map does not know, with their counts. Must be empty before anything is written."""
    known = F.try_element_at(literal_map(mapping or ATTACK_MAP), F.col(fine))
    return df.where(known.isNull()).groupBy(F.col(fine).alias("label")).agg(F.count("*").alias("n"))


def require_mapped(df: DataFrame, fine: str, mapping: dict | None = None) -> None:
    missing = [r["label"] for r in unmapped_labels(df, fine, mapping).limit(20).collect()]
    if missing:
        raise ValueError(f"unmapped labels: {missing}")


def is_benign(label: Column | None = None, binary: Column | None = None) -> Column:
    """The binary label decides where it exists, the label name otherwise."""
    if binary is not None:
        return binary == 0
    return label.isin(BENIGN_VALUES)


def verdict(category: Column, attack: str = "ANOMALY", benign: str = "NORMAL") -> Column:
    return F.when(category == "Benign", F.lit(benign)).otherwise(F.lit(attack))


def severity(category: Column, unknown: str | None = "UNKNOWN", table: dict[str, str] | None = None) -> Column:
    """Severity of a category, by the built-in table or by another one (a policy's ``severity_by_threat``).

    ``unknown=None`` leaves null, for the path that rejects such rows.
    """
    found = F.try_element_at(literal_map(table or SEVERITY), category)
    return found if unknown is None else F.coalesce(found, F.lit(unknown))


def translate_severity(level: Column) -> Column:
    """Rename the producer's severity; an unknown one becomes null and is reported as a violation."""
    return F.try_element_at(literal_map(SEVERITY_TRANSLATION), level)


# --- numbers -----------------------------------------------------------------------------------
def masked(value: Column, cutoff: float = OUTLIER_ABS_CUTOFF) -> Column:
    """NaN, infinities and magnitudes beyond the cutoff become null."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) <= cutoff), value)


def is_outlier(value: Column, cutoff: float = OUTLIER_ABS_CUTOFF) -> Column:
    """NaN compares above everything in Spark, so it is excluded: it was missing, not masked."""
    x = value.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) > cutoff), F.lit(False))


def mask_outliers(df: DataFrame, columns: list[str], cutoff: float = OUTLIER_ABS_CUTOFF) -> DataFrame:
    return df.withColumns({c: masked(F.col(c), cutoff) for c in columns})


def outlier_counts(df: DataFrame, columns: list[str], cutoff: float = OUTLIER_ABS_CUTOFF) -> DataFrame:
    wide = df.agg(*[F.count_if(is_outlier(F.col(c), cutoff)).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "n_masked")


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double; what does not parse becomes null. A plain cast would fail under ANSI mode."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def coercion_failures(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = lambda c: F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()
    wide = df.agg(*[F.count_if(bad(c)).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "n_failed")


def fit_medians(df: DataFrame, columns: list[str], split: str = "split", train: str = "train") -> DataFrame:
    """(feature, median) over the train rows only."""
    return exact_percentiles(df.where(F.col(split) == train), columns, [0.5]).withColumnRenamed("p0", "median")


def impute(df: DataFrame, columns: list[str], medians: DataFrame) -> DataFrame:
    """Fill nulls with the fitted medians, which arrive as one scalar map (one entry per column)."""
    table = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("m")).scalar()
    df = df.withColumn("_medians", table)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.try_element_at(F.col("_medians"), F.lit(c))) for c in columns}
    return df.withColumns(filled).drop("_medians")


# --- types -------------------------------------------------------------------------------------
_INT_RANGES = [("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)]
FLOAT_MAX = 3.4028234663852886e38


def plan_types(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Narrowest type holding each column's whole observed range (one small row per column).

    A double column becomes float only if every value comes back unchanged; one digit lost keeps it.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    real = [c for c in columns if not isinstance(kinds[c], T.IntegralType)]
    changed = lambda c: F.coalesce(~F.isnan(F.col(c).cast("double")) & (F.col(c).cast("float").cast("double") != F.col(c).cast("double")), F.lit(False))
    lossy = df.agg(*[F.count_if(changed(c)).alias(c) for c in real]).first().asDict() if real else {}
    plan = {}
    for row in column_profile(df, columns).collect():
        low, high, name = row["min_value"], row["max_value"], row["column_name"]
        if low is None:
            continue
        if isinstance(kinds[name], T.IntegralType):
            plan[name] = next(t for t, bits in _INT_RANGES if low >= -(2.0 ** bits) and high <= 2.0 ** bits - 1)
        else:
            plan[name] = "float" if max(abs(low), abs(high)) <= FLOAT_MAX and not lossy[name] else "double"
    return plan


def narrow_types(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Cast by plan. Under ANSI mode an integer that does not fit fails the job, never wraps."""
    casts = {}
    for name, target in plan.items():
        if target in ("float", "double"):
            casts[name] = F.col(name).cast(target)
        else:
            narrowed = F.col(name).cast(target)
            casts[name] = F.when(narrowed == F.col(name), narrowed).when(F.col(name).isNull(), None).otherwise(
                F.raise_error(F.lit(f"casting {name} to {target} would change its values"))
            )
    return df.withColumns(casts)


# --- column alignment --------------------------------------------------------------------------
def align_columns(df: DataFrame, required: list[str], medians: dict[str, float]) -> tuple[DataFrame, dict]:
    """Match required features case-insensitively; an absent one becomes its train median.

    Returns the frame and a report of missing features and ignored extra columns.
    """
    present = {c.strip().lower(): c for c in df.columns}
    missing = [f for f in required if f.lower() not in present]
    wanted = {f.lower() for f in required}
    extras = [c for c in df.columns if c.strip().lower() not in wanted]
    selected = [
        F.lit(float(medians[f])).alias(f) if f in missing else F.col(f"`{present[f.lower()]}`").alias(f)
        for f in required
    ]
    kept = [F.col(f"`{c}`") for c in extras]
    return df.select(*selected, *kept), {"missing": missing, "ignored": extras}
