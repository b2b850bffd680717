"""Random choices as pure functions of a seed: the same on any engine and with any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticket(seed, *keys: Column) -> Column:
    """A hex text; ordering by it is a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def uniform(seed, *keys: Column) -> Column:
    """A number in [0, 1) of 52 bits."""
    return F.conv(F.substring(ticket(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
