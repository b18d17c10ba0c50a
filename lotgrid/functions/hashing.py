"""Seeded arithmetic hash in [0, 2^32).

Plain integer arithmetic, so the same sample can be recomputed by any SQL engine
and does not depend on partitioning or on task retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32
_KEY_RANGE = (1 << 31) - 1
# Above any column number, and not near a small number modulo _KEY_RANGE.
CELL_FACTOR = 3_000_000_019


def seed_terms(seed: int) -> tuple[int, int]:
    """Offset of the first round and odd factor of the second: different seeds share neither."""
    return (seed * 2246822519 + 374761393) % HASH_RANGE, (1103515245 + seed * 668265262) % (1 << 31) | 1


def hash32(key: Column, seed: int = 0) -> Column:
    """Two multiplicative rounds over an integer key; every product stays below 2^63."""
    offset, factor = seed_terms(seed)
    first = F.pmod(F.pmod(key.cast("bigint"), F.lit(_KEY_RANGE)) * F.lit(2654435761) + F.lit(offset), F.lit(HASH_RANGE))
    mixed = first.bitwiseXOR(F.shiftright(first, 16))
    second = F.pmod(mixed * F.lit(factor) + F.lit(12345), F.lit(HASH_RANGE))
    return second.bitwiseXOR(F.shiftright(second, 15))


def uniform(key: Column, seed: int = 0) -> Column:
    """Hash mapped to [0, 1)."""
    return hash32(key, seed) / F.lit(float(HASH_RANGE))


def cell_key(row: Column, col: Column) -> Column:
    """One integer key for a raster cell or patch origin; rows and columns may reach 2^31 - 1."""
    return row.cast("bigint") * F.lit(CELL_FACTOR) + col.cast("bigint")
