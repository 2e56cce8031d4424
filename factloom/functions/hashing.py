"""Reproducible draws: 60-bit integers from md5, equal on every engine and every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5int(*parts: Column | str | int) -> Column:
    """Non-negative integer below 2^60 from the ``|``-joined text of longs and strings."""
    cols = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draw(n: Column, *parts: Column | str | int) -> Column:
    """Uniform index in ``0..n-1``."""
    return F.pmod(md5int(*parts), n)


def unit(*parts: Column | str | int) -> Column:
    """Uniform double in (0, 1)."""
    return (md5int(*parts) + F.lit(0.5)) / F.lit(float(2**60))
