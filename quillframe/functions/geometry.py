"""Colour, rectangle and layout functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout constants in points and pixels.
DPI, STAMP_SCALE, MIN_FIELD_HEIGHT, INK_RGB = 200, 4, 11.0, (0x25, 0x63, 0xEB)


def channel(color: Column, shift: int) -> Column:
    return F.shiftright(color, shift).bitwiseAND(255) / F.lit(255.0)


def rgb(color: Column) -> tuple[Column, Column, Column]:
    return channel(color, 16), channel(color, 8), channel(color, 0)


def is_blue(color: Column) -> Column:
    r, g, b = rgb(color)
    return F.coalesce((b > 0.35) & (b > r + 0.08) & (b > g + 0.05), F.lit(False))


def is_near_black(color: Column) -> Column:
    """Missing colours count as black."""
    r, g, b = rgb(color)
    return F.coalesce((r < 0.35) & (g < 0.35) & (b < 0.35), F.lit(True))


def round_tenth(y: Column) -> Column:
    """Tenths of y, rounded by its exact binary value, exact ties to even."""
    n = F.floor(y * 10)
    # y * 10 may round across a whole number, so the neighbour below is tried too.
    n = F.when(n / 10 > y, n - 1).otherwise(n)
    odd = (2 * n + 1).cast("double")
    mid = odd / 20
    rest = (odd - 16 * mid) - 4 * mid
    up = (y > mid) | ((y == mid) & ((rest < 0) | ((rest == 0) & (n % 2 != 0))))
    return n + F.when(up, 1).otherwise(0)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = lambda r: F.abs((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]))
    inter = w * h
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-6)))


def field_rect(m: dict[str, Column], label_height: Column, page_x0: Column, page_x1: Column) -> dict[str, Column]:
    """A mapped box grown to a field: label height, same centre, within the page's sides."""
    h = F.greatest(m["y1"] - m["y0"], label_height * 1.15, F.lit(MIN_FIELD_HEIGHT))
    cy = (m["y0"] + m["y1"]) / 2
    x0, x1 = F.greatest(page_x0, m["x0"]), F.least(page_x1, m["x1"])
    return {"x0": x0, "y0": cy - h / 2, "x1": F.when(x1 - x0 < 2, x0 + F.greatest(F.lit(2.0), m["x1"] - m["x0"])).otherwise(x1), "y1": cy + h / 2}


def to_pixels(c: Column, dpi: int = DPI) -> Column:
    return (c * (dpi / 72.0)).cast("int")


def stamp_layout(cell: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Where an image of width x height pixels lands in a cell, and its pixels there."""
    inset = (cell["x1"] - cell["x0"] - 2 >= 2) & (cell["y1"] - cell["y0"] - 2 >= 2)
    side = F.when(inset, 1.0).otherwise(0.0)
    x0, y0 = cell["x0"] + side, cell["y0"] + side
    tw, th = cell["x1"] - cell["x0"] - 2 * side, cell["y1"] - cell["y0"] - 2 * side
    aspect = width.cast("double") / F.greatest(height.cast("double"), F.lit(1.0))
    nh1 = F.greatest(F.lit(1.0), th * 0.85)
    nw1 = nh1 * aspect
    wide = nw1 > tw * 1.15
    nw2 = F.when(wide, tw * 1.15).otherwise(nw1)
    nh2 = F.when(wide, nw2 / F.greatest(aspect, F.lit(1e-6))).otherwise(nh1)
    tall = nh2 > th
    nh3 = F.when(tall, th).otherwise(nh2)
    nw3 = F.when(tall, nh3 * aspect).otherwise(nw2)
    nw, nh = F.greatest(F.lit(1.0), nw3), F.greatest(F.lit(1.0), nh3)
    dy = y0 + F.greatest(F.lit(0.0), (th - nh) / 2)
    pixels = lambda n: F.greatest(F.lit(1), F.rint(n * STAMP_SCALE).cast("int"))
    return {"px0": x0, "py0": dy, "px1": x0 + nw, "py1": dy + nh, "px_w": pixels(nw), "px_h": pixels(nh)}


def ink_alpha(v: Column) -> Column:
    """Alpha of a gray value: darkness, faint values clear, slightly lifted."""
    d = (255.0 - v) / F.lit(255.0)
    return F.when(d < 0.05, 0).otherwise((F.pow(d, F.lit(0.85)) * 255.0).cast("int"))
