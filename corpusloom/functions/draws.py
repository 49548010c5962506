"""Pseudo-random draws that depend on a row key and a seed only.

``rand()`` would give other values after every repartition. A draw from ``md5(key, seed)`` is the
same on every layout of the data, in batch and in streams.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SCALE = float(2**32)


def digest(*parts: Column) -> Column:
    """32 hex digits for the given key parts."""
    return F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))


def draw_int(hexed: Column, start: int) -> Column:
    """Integer in [0, 2^32) from eight hex digits beginning at 1-based ``start``."""
    return F.conv(F.substring(hexed, start, 8), 16, 10).cast("bigint")


def draw_unit(hexed: Column, start: int) -> Column:
    """Double in [0, 1)."""
    return draw_int(hexed, start) / F.lit(SCALE)


def below(hexed: Column, share: float) -> Column:
    """Whether ``draw_unit(hexed, 1) < share``, told from the digits without converting them."""
    border = math.ceil(share * SCALE)
    if border >= SCALE:
        return F.lit(True)
    return hexed < F.lit(f"{max(border, 0):08x}")
