"""Reproducible random numbers: a hash of (seed, rep, key), the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_int(seed: int, *keys: Column) -> Column:
    """0 .. 2**32 - 1 from md5 of the seed and keys joined by bars."""
    joined = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(seed: int, *keys: Column) -> Column:
    return hash_int(seed, *keys) / F.lit(float(2**32))
