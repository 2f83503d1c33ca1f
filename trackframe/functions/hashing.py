"""Uniform numbers from md5, the same in any engine and for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Twelve hexadecimal digits.
_RANGE = float(16**12)


def uniform(purpose: str, *keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from a seed, key columns and a purpose."""
    parts = [F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys), F.lit(purpose)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("double") / _RANGE


def uniform_sql(purpose: str, *keys: str, seed: int = 0) -> str:
    """The same in the oracle's SQL."""
    text = " || '|' || ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys), f"'{purpose}'"])
    return f"(CAST(('0x' || substr(md5({text}), 1, 12)) AS BIGINT) / {_RANGE})"


def between(u: Column, low: float, high: float) -> Column:
    return low + u * (high - low)


def normal(u1: Column, u2: Column) -> Column:
    """A standard normal number from two uniform ones (Box-Muller)."""
    return F.sqrt(-2 * F.ln(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * F.pi() * u2)
