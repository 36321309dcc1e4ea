"""Colours of clusters and genes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_rgb(color: Column) -> Column:
    """``#RRGGBB`` as ARRAY<INT> of three; null unless it is of that form."""
    part = lambda at: F.conv(F.substring(color, at, 2), 16, 10).cast("int")
    return F.when(color.rlike("^#[0-9A-Fa-f]{6}$"), F.array(part(2), part(4), part(6)))


def hue_to_rgb(hue: Column) -> Column:
    """Full colour of a hue in 0 to 1 as ARRAY<INT> of three, 0 to 255, truncated."""

    def channel(shift: float) -> Column:
        k = F.pmod(F.lit(shift) + hue * 6, F.lit(6.0))
        return F.floor(255 * (1 - F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))).cast("int")

    return F.array(channel(5), channel(3), channel(1))
