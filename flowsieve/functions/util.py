"""Small helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qcol(name: str) -> Column:
    """Column reference that tolerates spaces, dots and slashes in the name."""
    return F.col(f"`{name}`")


def md5_u32(key) -> Column:
    """Deterministic 32-bit hash in [0, 2**32): first 8 hex digits of md5(key).

    Chosen over ``hash()``/``rand()`` because any engine can reproduce it
    (``('0x' || substr(md5(k), 1, 8))::BIGINT`` in SQL engines)."""
    return F.conv(F.substring(F.md5(as_col(key).cast("string")), 1, 8), 16, 10).cast("bigint")


U32 = 4294967296  # 2**32


def round6(c) -> Column:
    """Round to 6 decimals and fold -0.0 into 0.0 so results hash identically everywhere."""
    return F.round(as_col(c), 6) + F.lit(0.0)
