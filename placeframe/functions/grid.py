"""A planar grid of pointy-top hexagons: cell of a point, centre, ring offsets and area."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An id holds two axial steps of 32 bits.
SHIFT = 1 << 32


def cell(x: Column, y: Column, size: float) -> Column:
    """Id of the hexagon with edge `size` that holds the point: axial coordinates by cube rounding, in one number."""
    q = (x * (math.sqrt(3) / 3) - y / 3) / size
    r = y * (2 / 3) / size
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q2 = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r2 = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return (q2.cast("long") * SHIFT + r2 + SHIFT // 2).cast("long")


def axial(cell_id: Column) -> tuple[Column, Column]:
    return F.shiftright(cell_id, 32), cell_id.bitwiseAND(F.lit(SHIFT - 1)) - SHIFT // 2


def centre(cell_id: Column, size: float) -> tuple[Column, Column]:
    q, r = axial(cell_id)
    return size * (math.sqrt(3) * q + math.sqrt(3) / 2 * r), size * 1.5 * r


def disk(cell_id: Column, rings: int) -> Column:
    """Array of the ids within `rings` steps."""
    steps = [(q, r) for q in range(-rings, rings + 1) for r in range(-rings, rings + 1) if abs(q + r) <= rings]
    return F.array(*[(cell_id + q * SHIFT + r).cast("long") for q, r in steps])


def area(size: float) -> float:
    return 1.5 * math.sqrt(3) * size * size
