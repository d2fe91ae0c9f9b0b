"""Identifiers and total orders as fixed-width columns, so that aggregates on them stay hash aggregates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_UUID = r"^(?i:urn:uuid:)?\{?(?![0-]+\}?\z)[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?\z"
_SHIFT = "9223372036854775808BD"
_WIDTH = "100000000000000000000BD"
_LAST_US = 890_000_000_000_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_uuid(c: str | Column) -> Column:
    """Whether a string is a UUID other than the nil one, in any of its spellings; null for null."""
    return col(c).rlike(_UUID)


def uuid_bytes(c: str | Column) -> Column:
    """The 16 bytes of a string that ``is_uuid``."""
    return F.unhex(F.right(F.translate(col(c), "-{}", ""), F.lit(32)))


def uuid_key(c: str | Column) -> Column:
    """The 16 bytes of a UUID in any of its spellings (case, hyphens, braces, ``urn:uuid:``).

    Null for null, empty and malformed strings and for the nil UUID: these identify nothing.
    """
    return F.when(is_uuid(c), uuid_bytes(c))


def blank_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(c != "", c)


def packed_order(when_us: Column, key: Column) -> Column:
    """(time in microseconds, bigint key) as one decimal that sorts the same way; a null time sorts last.

    A decimal has a fixed-width slot in Spark's aggregation buffer, a struct has none: ``min``, ``max`` and
    ``min_by`` over it run as hash aggregates with map-side combination rather than as sort aggregates.
    """
    t = F.coalesce(when_us, F.lit(_LAST_US)).cast("decimal(18,0)")
    k = key.cast("decimal(19,0)") + F.expr(_SHIFT)
    return (t * F.expr(_WIDTH) + k).cast("decimal(38,0)")


def packed_key(p: Column) -> Column:
    """The key of a ``packed_order`` value."""
    return ((((p % F.expr(_WIDTH)) + F.expr(_WIDTH)) % F.expr(_WIDTH)) - F.expr(_SHIFT)).cast("bigint")


def packed_us(p: Column) -> Column:
    """The time of a ``packed_order`` value."""
    t = F.floor(p / F.expr(_WIDTH)).cast("bigint")
    return F.when(t < _LAST_US, t)
