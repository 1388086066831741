"""Column arithmetic between world, cells, tiles and pixels. Floors go down for negatives; nothing here truncates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b) -> Column:
    return F.floor(a / b).cast("long")


def checked(c: Column, what: str) -> Column:
    """c, or an error for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{what} is not finite"))).otherwise(c)


def world_to_cell(c: Column, size: float) -> Column:
    if size <= 0:
        raise ValueError("the cell size must be positive")
    return F.floor(checked(c.cast("double"), "a coordinate") / F.lit(float(size))).cast("long")


def cell_extent(cx: Column, cy: Column, size: float, grow: float = 0.0) -> list[Column]:
    """min_x, min_y, max_x, max_y of a half-open cell box, grown on every side."""
    if grow < 0:
        raise ValueError("a box cannot grow by less than nothing")
    return [cx * size - grow, cy * size - grow, (cx + 1) * size + grow, (cy + 1) * size + grow]


def world_to_pixel(x: Column, y: Column, left: float, top: float, scale: float) -> list[Column]:
    """Pixel coordinates from a top-left origin; y is turned once."""
    return [(x - left) / scale, (F.lit(top) - y) / scale]


def pixel_to_world(px: Column, py: Column, left: float, top: float, scale: float, centre: bool = False) -> list[Column]:
    half = 0.5 if centre else 0.0
    return [(px + half) * scale + left, F.lit(top) - (py + half) * scale]


def units_per_pixel(z: Column, reference: float, reference_zoom: int) -> Column:
    return F.lit(reference) * F.pow(F.lit(2.0), F.lit(reference_zoom) - z)


def world_to_tile(x: Column, y: Column, z: Column, left: float, top: float, reference: float, reference_zoom: int, tile: int) -> list[Column]:
    size = units_per_pixel(z, reference, reference_zoom) * tile
    return [F.floor((x - left) / size).cast("long"), F.floor((F.lit(top) - y) / size).cast("long")]


def tile_extent(tx: Column, ty: Column, size: Column, left: float, top: float) -> list[Column]:
    return [tx * size + left, F.lit(top) - (ty + 1) * size, (tx + 1) * size + left, F.lit(top) - ty * size]


def cell_to_tile(cx: Column, cy: Column, min_cx: int, max_cy: int) -> list[Column]:
    """Tiles of one cell each, numbered from the top-left cell."""
    return [cx - min_cx, F.lit(max_cy) - cy]


def tile_to_cell(tx: Column, ty: Column, min_cx: int, max_cy: int) -> list[Column]:
    return [tx + min_cx, F.lit(max_cy) - ty]


def aligned(value: Column, size: float) -> Column:
    """value / size as a whole number, or an error if it is further than 1e-9 from one."""
    q = value / size
    return F.when(F.abs(q - F.round(q)) > 1e-9, F.raise_error(F.lit("an extent is not aligned to cells"))).otherwise(F.round(q).cast("long"))


def shard_center(c: Column, k: int = 3) -> Column:
    return F.lit(k) * floor_div(c + k // 2, k)


def round_half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5), which rounds halves towards the greater number."""
    return F.floor(c + 0.5).cast("long")


def to_byte(c: Column) -> Column:
    return F.least(F.greatest(F.floor(c + 0.5), F.lit(0)), F.lit(255)).cast("int")


def distance2(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x0 - x1, y0 - y1)


def distance3(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)
