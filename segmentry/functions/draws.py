"""Reproducible draws: a uniform number follows from a seed and the row's own key, so any engine and any partitioning draws alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def uniform(seed: int | str, *keys: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 digest, all that a double holds below 1."""
    return F.conv(F.substring(digest(seed, *keys), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def index(seed: int | str, n: Column | int, *keys: Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(seed, *keys) * (F.lit(n) if isinstance(n, int) else n)).cast("long")
