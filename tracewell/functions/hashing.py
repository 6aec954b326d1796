"""Stable hash columns used for ordering, sampling and content identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def stable_hash(seed: int, *parts: Column | str) -> Column:
    """Hex sha256 of ``seed:part:part``; fixed width, so text order equals numeric order."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts]), 256)


def hex_mod(digest: Column, modulus: int) -> Column:
    """Remainder of a hex digest for a power-of-two modulus up to 16: its last digit decides."""
    return (F.conv(F.right(digest, F.lit(1)), 16, 10).cast("int") % modulus).cast("int")


def hash_int31(digest: Column) -> Column:
    """First sixteen hex digits of the digest modulo 2**31."""
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(2147483647))


def hash_unit(digest: Column) -> Column:
    return hash_int31(digest) / F.lit(2147483648.0)


def text_hash(text: Column | str) -> Column:
    return F.sha2(col(text), 256)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON object with sorted keys."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def content_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def set_digest(digest: Column) -> Column:
    """Aggregate: order-free digest of a set of hex digests.

    Eight 32-bit pieces are summed with map-side combine, so the digest of any number of rows costs
    one tiny row per task; a digest of the sorted list would need them all in one place.
    """
    sums = [
        F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
        .cast("decimal(38,0)")
        .cast("string")
        for i in range(8)
    ]
    return F.sha2(F.concat_ws(",", *sums), 256)
