"""Viewer styling as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors of the id hash, the golden ratio step, and the hue band that is moved.
HASH_SPREAD, HASH_MIX = 2654435761, 0x45D9F3B
HUE_STEP = 0.61803398875
BLUE_LOW, BLUE_HIGH, BLUE_SHIFT = 0.62, 0.7, 0.2
SATURATION, VALUE = 0.85, 0.95
_WORD = 1 << 32


def _times(x: Column, factor: int) -> Column:
    """Product modulo 2**32; decimals, as a bigint would overflow."""
    return (x.cast("decimal(20,0)") * F.lit(factor).cast("decimal(18,0)") % F.lit(_WORD).cast("decimal(20,0)")).cast("bigint")


def _fold(x: Column) -> Column:
    return F.shiftright(x, 16).bitwiseXOR(x)


def hash_id(id_: Column) -> Column:
    """32-bit hash of an id, as bigint."""
    x = _times(F.pmod(id_.cast("bigint"), F.lit(_WORD)), HASH_SPREAD)
    for _ in range(2):
        x = _times(_fold(x), HASH_MIX)
    return _fold(x)


def hue(hashed: Column) -> Column:
    h = hashed.cast("double") * HUE_STEP % 1.0
    return F.when((h >= BLUE_LOW) & (h <= BLUE_HIGH), (h + BLUE_SHIFT) % 1.0).otherwise(h)


def hsv_to_rgb(h: Column, s: float = SATURATION, v: float = VALUE) -> tuple[Column, Column, Column]:
    """Red, green and blue of a hue in [0, 1]; six sectors."""
    if s == 0:
        return F.lit(v), F.lit(v), F.lit(v)
    sector = F.floor(h * 6).cast("int")
    f = h * 6 - sector
    low, down, up, top = F.lit(v * (1 - s)), v * (1 - s * f), v * (1 - s * (1 - f)), F.lit(v)
    part = sector % 6
    picks = ((top, up, low), (down, top, low), (low, top, up), (low, down, top), (up, low, top), (top, low, down))

    def channel(k: int) -> Column:
        found = F.when(part == 0, picks[0][k])
        for i in range(1, 5):
            found = found.when(part == i, picks[i][k])
        return found.otherwise(picks[5][k])

    return channel(0), channel(1), channel(2)


def marker_scale(explicit: Column) -> Column:
    return F.when(explicit, 0.5).otherwise(0.2)


def marker_alpha(explicit: Column) -> Column:
    return F.when(explicit, 1.0).otherwise(0.3)


def line_width(explicit: Column) -> Column:
    return F.when(explicit, 0.3).otherwise(0.1)


def marker_name(seq: int | Column, id_: Column) -> Column:
    return F.concat(F.lit("seq_"), F.lit(seq).cast("string"), F.lit("/"), id_.cast("string"))
