"""Reproducible randomness.

A draw is a hash of what it is drawn for, so it does not depend on how rows are
partitioned, on retries, or on the order in which tasks run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_uniform(*cols: Column | str, seed: int = 42, salt: str = "") -> Column:
    """Uniform double in [0, 1): first 32 bits of md5("seed|col|...|salt")."""
    parts = [F.lit(str(seed)), *[_col(c).cast("string") for c in cols], F.lit(salt)]
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def hash_index(n: Column, *cols: Column | str, seed: int = 42, salt: str = "") -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(hash_uniform(*cols, seed=seed, salt=salt) * n).cast("int")
