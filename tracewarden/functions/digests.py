"""Digest, identifier and address expressions (column in, column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DIGEST_FIELDS, URL_NAMESPACE_HEX
from .text import fixed6, null_byte

HEX64 = "^[0-9a-f]{64}$"


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def canonical_string(field: dict[str, Column], float_fields: tuple[str, ...] = ("confidence",)) -> Column:
    """Producer text: fixed field order, ``key=value`` joined by a pipe, null as the 0x00 byte."""
    parts = []
    for name in DIGEST_FIELDS:
        column = field[name]
        text = fixed6(column) if name in float_fields else column.cast("string")
        parts.append(F.concat(F.lit(name + "="), F.coalesce(text, null_byte())))
    return F.concat_ws("|", *parts)


def alert_canonical_string(prefix: str = "") -> Column:
    return canonical_string({name: F.col(prefix + name) for name in DIGEST_FIELDS})


def feature_text(features: Column) -> Column:
    """Sorted ``key=%.6f`` text of a feature map."""
    entries = F.array_sort(F.map_entries(features))
    rendered = F.transform(
        entries,
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.format_string("%.6f", e["value"]), null_byte())),
    )
    return F.array_join(rendered, "|")


def feature_digest(features: Column) -> Column:
    return sha256_hex(feature_text(features))


def resource_id(address: Column) -> Column:
    return F.concat(F.lit("cloud-res-"), F.substring(sha256_hex(address), 1, 12))


def format_address(ip: Column, port: Column) -> Column:
    return F.when(ip.isNotNull(), F.concat_ws(":", ip, port.cast("string")))


def content_address(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), sha256_hex(payload))


def parse_address(address: Column) -> Column:
    """64 lower-case hex digits of a bare or prefixed address; null when it is not well formed."""
    digest = F.lower(F.regexp_replace(address, "^sha256:", ""))
    return F.when(digest.rlike(HEX64), digest)


def uuid5(name: Column, namespace_hex: str = URL_NAMESPACE_HEX) -> Column:
    """Name-based UUID: SHA-1 over namespace bytes and name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substring(digest, 17, 1)
    variant = F.translate(variant, "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def hmac_pads(key_hex: Column) -> tuple[Column, Column]:
    """Inner and outer key blocks (binary) of a hex key of at most 64 bytes; null for a null key.

    Computed once per key on the key table, so that signing a row costs two hashes.
    """
    digits = "0123456789abcdef"
    padded = F.rpad(F.lower(key_hex), 128, "0")

    def mask(byte: int) -> Column:
        # xor of every key byte with a constant, one nibble at a time
        high = "".join(digits[d ^ (byte >> 4)] for d in range(16))
        low = "".join(digits[d ^ (byte & 15)] for d in range(16))
        # both tables go over the whole key once; the array binds their texts, so that no byte does it again
        sides = F.array(F.struct(F.translate(padded, digits, high).alias("high"), F.translate(padded, digits, low).alias("low")))
        text = F.transform(sides, lambda s: F.array_join(F.transform(
            F.sequence(F.lit(1), F.lit(127), F.lit(2)),
            lambda i: F.concat(F.substr(s["high"], i, F.lit(1)), F.substr(s["low"], i + 1, F.lit(1))),
        ), ""))[0]
        return F.when(key_hex.isNotNull(), F.unhex(text))

    return mask(0x36), mask(0x5C)


def hmac_sha256(inner_pad: Column, outer_pad: Column, message: Column) -> Column:
    """Keyed digest from built-in SHA-2.

    Symmetric: it authenticates the writer to whoever holds the key table, and gives no
    non-repudiation.
    """
    inner = F.sha2(F.concat(inner_pad, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def hash_rank_key(row_id: Column, seed: int) -> Column:
    """Seeded ordering key that does not depend on partitioning."""
    return sha256_hex(F.concat(row_id.cast("string"), F.lit(f":{seed}")))
