"""Marker colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Golden-angle step on the hue circle, saturation, value.
HUE_STEP, SATURATION, VALUE = 0.61803398875, 0.85, 0.95


def marker_color(index: Column) -> Column:
    """Distinct vivid colour by marker index."""
    hue = F.pmod(index * F.lit(HUE_STEP), F.lit(1.0))
    sector = F.floor(hue * 6)
    f = hue * 6 - sector
    low = F.lit(VALUE * (1.0 - SATURATION))
    high = F.lit(VALUE)
    falling = VALUE * (1.0 - SATURATION * f)
    rising = VALUE * (1.0 - SATURATION * (1.0 - f))
    by_sector = {
        "r": (high, falling, low, low, rising, high),
        "g": (rising, high, high, falling, low, low),
        "b": (low, low, rising, high, high, falling),
    }

    def channel(name: str) -> Column:
        out = F.when(sector == 0, by_sector[name][0])
        for i in range(1, 6):
            out = out.when(sector == i, by_sector[name][i])
        return F.floor(out * 255).cast("int").alias(name)

    return F.struct(*[channel(c) for c in "rgb"])


def contrast_color(rgb: Column) -> Column:
    """``black`` on light markers, ``white`` on dark ones."""
    luminance = 0.299 * rgb["r"] + 0.587 * rgb["g"] + 0.114 * rgb["b"]
    return F.when(luminance > 140, "black").otherwise("white")
