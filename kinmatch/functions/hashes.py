"""Perceptual hashes, digests and orders made from digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHASH = "^[0-9a-fA-F]{16}$"


def phash_bits(c: Column | str) -> Column:
    """64 bits of a hash of 16 hex digits as a signed long; null for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(PHASH), F.conv(F.lower(c), 16, -10).cast("long"))


def hamming(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def stable_order(seed: int | str, c: Column | str) -> Column:
    """A digest to order by: the same everywhere, unlike any natural order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string") if isinstance(c, str) else c.cast("string")), 256)
