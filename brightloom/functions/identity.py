"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def digest_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """A prefix and the first hex digits of the SHA-1 over the joined parts."""
    joined = F.concat_ws(SEPARATOR, *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined.cast("binary")), 1, length))


def snapshot_hash(*fields: Column) -> Column:
    """SHA-256 over a JSON object of the fields, in the order given."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)
