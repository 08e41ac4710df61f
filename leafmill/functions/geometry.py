"""Boxes on a page as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The page that a missing size means, and what an image is shown at.
DEFAULT_PAGE = (959.76, 540.0)
DISPLAY_SCALE = 0.85


def area(w: Column, h: Column) -> Column:
    return F.coalesce(w, F.lit(0.0)) * F.coalesce(h, F.lit(0.0))


def area_ratio(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Share of the page, null where the page has no size."""
    return area(w, h) / F.nullif(page_w * page_h, F.lit(0.0))


def _thirds(x: Column, y: Column, low: float, high: float) -> Column:
    across = F.when(x < low, "left").when(x > high, "right").otherwise("center")
    down = F.when(y < low, "top").when(y > high, "bottom").otherwise("middle")
    return F.concat(down, F.lit("_"), across)


def _centre(at: Column, size: Column, page: Column) -> Column:
    return F.when(page != 0, (at + size / 2) / page).otherwise(F.lit(0.5))


def placement(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """full, a band across the page, or one of nine places by the box's centre."""
    wide = F.when(page_w != 0, w / page_w).otherwise(F.lit(0.0))
    high = F.when(page_h != 0, h / page_h).otherwise(F.lit(0.0))
    cx, cy = _centre(x, w, page_w), _centre(y, h, page_h)
    band = F.when(cy < 0.35, "band_top").when(cy > 0.65, "band_bottom").otherwise("band_middle")
    return F.when((wide >= 0.95) & (high >= 0.95), "full").when((wide >= 0.9) & (high <= 0.35), band).otherwise(_thirds(cx, cy, 0.38, 0.62))


def placement_of_nine(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """One of nine places by the box's centre."""
    return _thirds(_centre(x, w, page_w), _centre(y, h, page_h), 0.38, 0.62)


def placement_of_corner(left: Column, top: Column, page_w: Column, page_h: Column) -> Column:
    """One of nine places by a line's upper left corner."""
    x = F.when(page_w != 0, left / page_w).otherwise(F.lit(0.5))
    y = F.when(page_h != 0, top / page_h).otherwise(F.lit(0.5))
    return _thirds(x, y, 0.38, 0.62)


def size_bucket(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    share = area(w, h) / (page_w * page_h)
    return F.when(share >= 0.35, "xl").when(share >= 0.18, "lg").when(share >= 0.08, "md").otherwise("sm")


def display_size(w: Column) -> Column:
    return F.round(w * F.lit(DISPLAY_SCALE), 2)


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of components from 0 to 1, clamped; null if one is missing."""

    def two(c: Column) -> Column:
        return F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c * 255).cast("int")))), 2, "0"))

    return F.when(r.isNotNull() & g.isNotNull() & b.isNotNull(), F.concat(F.lit("#"), two(r), two(g), two(b)))


def fits(w: Column, h: Column, page_area: Column) -> Column:
    """Large enough to be a container or an image, and not the page itself."""
    return (w >= 12) & (h >= 12) & (w * h >= 800) & (w * h <= 0.95 * page_area)
