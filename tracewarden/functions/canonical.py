"""Canonical JSON of a typed struct, built as one column expression from its schema.

Struct members are sorted once, when the expression is built; map keys are sorted per row. Floats are
rendered by ``repr_double``, or by the shorter ``repr6`` (``floats="six"``: at most six decimals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import escape_controls, quoted, repr6, repr_double

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


class _Builder:
    """Walks a schema and renders every value of it."""

    def __init__(self, optional: set[str], exact: bool, item_sep: str, key_sep: str):
        self.item_sep, self.key_sep, self.optional = item_sep, key_sep, optional
        self.number = repr_double if exact else repr6

    def render(self, value: Column, dtype: T.DataType, path: str) -> Column:
        if isinstance(dtype, T.StructType):
            text = self._struct(value, dtype, path)
        elif isinstance(dtype, T.MapType):
            text = self._map(value, dtype, path)
        elif isinstance(dtype, T.ArrayType):
            text = self._array(value, dtype, path)
        elif isinstance(dtype, T.StringType):
            text = quoted(value)
        elif isinstance(dtype, (T.BooleanType, *_INTEGRAL)):
            text = value.cast("string")
        elif isinstance(dtype, _FLOATING):
            text = self.number(value.cast("double"))
        else:
            raise TypeError(f"no canonical form for {dtype.simpleString()} at {path or 'top level'}")
        return F.when(value.isNull(), F.lit("null")).otherwise(text)

    def _struct(self, value: Column, dtype: T.StructType, path: str) -> Column:
        members = []
        for field in sorted(dtype.fields, key=lambda f: f.name.encode()):
            here = f"{path}.{field.name}" if path else field.name
            member = value[field.name]
            text = F.concat(quoted(F.lit(field.name)), F.lit(self.key_sep), self.render(member, field.dataType, here))
            if here in self.optional:
                text = F.when(member.isNotNull(), text)
            members.append(text)
        # concat_ws skips nulls, which is how optional members disappear
        return F.concat(F.lit("{"), F.concat_ws(self.item_sep, *members), F.lit("}"))

    def _map(self, value: Column, dtype: T.MapType, path: str) -> Column:
        body = F.transform(
            F.array_sort(F.map_entries(value)),
            lambda e: F.concat(quoted(e["key"]), F.lit(self.key_sep), self.render(e["value"], dtype.valueType, path)),
        )
        return F.concat(F.lit("{"), F.array_join(body, self.item_sep), F.lit("}"))

    def _array(self, value: Column, dtype: T.ArrayType, path: str) -> Column:
        body = F.transform(value, lambda e: self.render(e, dtype.elementType, path))
        return F.concat(F.lit("["), F.array_join(body, self.item_sep), F.lit("]"))


def with_canonical_json(
    df: DataFrame,
    source: str,
    out: str,
    optional: set[str] | None = None,
    drop_members: tuple[str, ...] = (),
    floats: str = "exact",
    spaced: bool = False,
) -> DataFrame:
    """Add ``out``, the canonical JSON of struct column ``source``.

    ``drop_members`` removes top-level members (the digest of a payload never covers itself).
    ``spaced`` writes a blank after commas and colons, which is the stored form of a payload.
    """
    dtype = df.schema[source].dataType
    if not isinstance(dtype, T.StructType):
        raise TypeError("the canonical value must be a struct at top level")
    kept = T.StructType([f for f in dtype.fields if f.name not in drop_members])
    builder = _Builder(optional or set(), floats == "exact", *((", ", ": ") if spaced else (",", ":")))
    text = builder.render(F.col(source), kept, "")
    df = df.withColumn(out, text)
    # never null, and said so: a nullable digest would draw inferred not-null filters through the
    # whole expression whenever it is joined on
    return df.withColumn(out, F.coalesce(escape_controls(F.col(out)), F.lit("null")))


def with_payload_digest(
    df: DataFrame, source: str, out: str = "payload_digest", optional: set[str] | None = None,
    floats: str = "exact",
) -> DataFrame:
    """SHA-256 of the canonical JSON of ``source`` without its ``payload_digest`` member."""
    df = with_canonical_json(df, source, "_canonical", optional, ("payload_digest",), floats)
    return df.withColumn(out, F.sha2("_canonical", 256)).drop("_canonical")


def digest_claim_holds(claim: Column, recomputed: Column) -> Column:
    """A malformed claim is false, and hex case does not matter."""
    return F.coalesce((F.length(claim) == 64) & (F.lower(claim) == recomputed), F.lit(False))

