"""Number and string text forms used by the digests.

All of them but ``fixed6_exact`` are JVM expressions. ``repr6`` is short for contract values, which are
rounded to six places before they are rendered; ``repr_double`` takes any double.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_byte() -> Column:
    """How the producer's canonical string writes a missing value: one 0x00 byte."""
    return F.chr(F.lit(0))


def fixed6(value: Column) -> Column:
    """``%.6f``; exact when the value already has at most six decimals."""
    return F.when(value.isNotNull(), F.format_string("%.6f", value))


@F.arrow_udf(T.StringType())
def fixed6_exact(values: pa.Array) -> pa.Array:
    """``%.6f`` rounding the exact binary value, for doubles that were never rounded."""
    return pa.array([None if v is None else f"{v:.6f}" for v in values.to_pylist()], pa.string())


#: Below this, doubles have fewer digits.
SUBNORMAL = 2.2250738585072014e-308
#: Doubles that are whole and still fit a 64-bit integer.
WHOLE = (2.0 ** 53, 9.2e18)


def repr_double(value: Column, subnormal: bool = True) -> Column:
    """Shortest round-trip text of any finite double, in the contract's notation.

    Fifteen, sixteen or seventeen significant digits (from one on for subnormal values), whichever is the
    first to give the same double back; positional from 1e-4 up to 1e16, otherwise with a signed exponent of two digits at least.
    NaN and infinities have no canonical text and fail the task. Without ``subnormal`` the expression is
    shorter, for values that are known to be 0 or above 1e-300 in magnitude.
    """
    def one(v: Column) -> Column:
        back = lambda form: form.cast("double") == v
        forms = {n: F.format_string(f"%.{n}e", v) for n in range(0 if subnormal else 14, 17)}
        short = F.filter(F.array(*forms.values()), back)[0] if subnormal else forms[16]
        shortest = F.when(F.abs(v) < SUBNORMAL, short).when(
            F.abs(v).between(*WHOLE), F.transform(F.array(F.abs(v).cast("long")), lambda n: F.concat(F.when(v < 0, "-").otherwise(""), whole_form(v, n)))[0]
        ).when(back(forms[14]), forms[14]).when(back(forms[15]), forms[15]).when(back(above(forms[15])), above(forms[15])).otherwise(forms[16])
        return F.transform(F.array(shortest), notation)[0]

    def above(form: Column) -> Column:
        """The next longer number of as many digits: a power of two reaches further up than down."""
        digits = (F.regexp_replace(F.substring_index(form, "e", 1), r"[-.]", "").cast("bigint") + 1).cast("string")
        sign = F.when(form.startswith("-"), "-").otherwise("")
        return F.concat(sign, F.substring(digits, 1, 1), F.lit("."), F.substr(digits, F.lit(2)), F.lit("e"), F.substring_index(form, "e", -1))

    def whole_form(v: Column, n: Column) -> Column:
        """From the exact digits, which the formatter does not always round well in this range."""
        def cut(digits: int) -> Column:
            unit = F.element_at(F.array(*[F.lit(10 ** k) for k in range(1, 5)]).cast("array<bigint>"), F.length(n.cast("string")) - digits)
            return F.when(F.length(n.cast("string")) > digits, F.floor((n + (unit / 2).cast("long")) / unit.cast("decimal(20,0)")).cast("long") * unit).otherwise(n)

        near = lambda digits: F.when(cut(digits).cast("double") == F.abs(v), cut(digits))
        digits = F.coalesce(near(15), near(16), near(17), n).cast("string")
        return F.concat(F.substring(digits, 1, 1), F.lit("."), F.substr(digits, F.lit(2)), F.lit("e"), (F.length(digits) - 1).cast("string"))

    def notation(text: Column) -> Column:
        parts = F.struct(
            F.when(text.startswith("-"), "-").otherwise("").alias("sign"), F.substring_index(text, "e", -1).cast("int").alias("e"),
            F.regexp_replace(F.regexp_replace(F.substring_index(text, "e", 1), r"[-.]", ""), r"(?<=.)0+$", "").alias("d"))
        return F.transform(F.array(parts), placed)[0]

    def placed(p: Column) -> Column:
        sign, e, d = p["sign"], p["e"], p["d"]
        whole = F.concat(F.rpad(F.substr(d, F.lit(1), e + 1), e + 1, F.lit("0")), F.lit("."), F.when(F.length(d) > e + 1, F.substr(d, e + 2)).otherwise("0"))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        tail = F.when(F.length(d) > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise("")
        power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
        body = F.when((e >= 0) & (e < 16), whole).when((e < 0) & (e >= -4), small).otherwise(F.concat(F.substring(d, 1, 1), tail, power))
        return F.concat(sign, body)

    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(value == 0, value.cast("string")).when(finite, one(value)).when(
        value.isNotNull(), F.raise_error(F.lit("NaN and infinity have no canonical form")).cast("string"))


def repr6(value: Column) -> Column:
    """Shortest round-trip text of a double with at most six decimals, of any magnitude.

    Below 1e9 such a number has at most 15 significant digits, and decimals that short are never shared
    by two doubles, so trimming the zeros of its decimal text gives the shortest form; below 1e-4 it
    takes two-digit exponent notation. Larger magnitudes take the general form.
    """
    plain = F.regexp_replace(value.cast("decimal(16,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    # 1.2E-5 -> 1.2e-05, 1.0E-6 -> 1e-06
    tiny = F.replace(F.replace(value.cast("string"), F.lit(".0E"), F.lit("E")), F.lit("E-"), F.lit("e-0"))
    return F.when(value == 0, value.cast("string")).when(F.abs(value).between(1e-7, 0.9999e-4), tiny).when(
        F.abs(value) < 1e9, plain).otherwise(repr_double(value, subnormal=False))


def quoted(value: Column) -> Column:
    """JSON string with quote and backslash escaped; control characters are left to ``escape_controls``."""
    body = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), body, F.lit('"'))


def escape_controls(text: Column) -> Column:
    """Escape control characters of a finished JSON text.

    The structure of compact JSON holds none, so all of them sit inside strings. The chain of
    replacements runs only for the rare text that needs it.
    """
    short = {"\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f"}
    full = text
    for code in range(0x20):
        full = F.replace(full, F.lit(chr(code)), F.lit(short.get(chr(code), f"\\u{code:04x}")))
    return F.when(text.rlike(r"[\x00-\x1f]"), full).otherwise(text)


def json_string(value: Column) -> Column:
    return escape_controls(quoted(value))


def rfc3339(ts: Column) -> Column:
    """UTC millisecond text with a Z suffix; the session time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_rfc3339(text: Column) -> Column:
    """Timestamp from either suffix (``Z`` or ``+00:00``), so that ordering is by time, not text."""
    return F.to_timestamp(text)


def normalise_name(text: Column) -> Column:
    return F.lower(F.trim(text))


def truncate(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)
