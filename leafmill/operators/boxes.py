"""Boxes of pages: filters, deduplication, numbering, assignment of points, nearest boxes, palettes, style dictionaries.

Every join and window has the page as a key, so pages are the unit of distribution and no page needs another's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry, text
from leafmill.sources.shipping import ship

#: Colours of a page's background, fills in a palette, and the largest distance to a match.
WHITE = ("#ffffff", "#fff")
PALETTE_FILLS = 8
NEAREST_LIMIT = 2.0


def container_boxes(drawings: DataFrame, page_area: Column) -> DataFrame:
    """Drawings that are containers: filled, visible, made of rectangles only, of a fitting size, and not a white page.

    drawings: page_id, ord, x, y, w, h, fill, fill_opacity, commands (array of the drawing's commands).
    """
    visible = F.col("fill").isNotNull() & (F.coalesce("fill_opacity", F.lit(1.0)) > 0)
    rectangles = (F.size("commands") > 0) & F.forall("commands", lambda c: c == "re")
    page = F.lower("fill").isin(*WHITE) & (F.col("w") * F.col("h") > 0.5 * page_area)
    return drawings.where(visible & rectangles & geometry.fits(F.col("w"), F.col("h"), page_area) & ~page)


def first_of_equal(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of those with equal keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distinct_boxes(boxes: DataFrame, by_fill: bool = True) -> DataFrame:
    """Without boxes that repeat another's place and size (to hundredths) on a page; the first stays. by_fill: boxes of another fill or
    opacity (to thousandths; none is 1) are others, as containers are; images go by place and size."""
    keys = [F.col("page_id"), *(F.round(c, 2) for c in ("x", "y", "w", "h"))]
    if by_fill:
        keys.append(F.col("fill"))
        if "fill_opacity" in boxes.columns:
            keys.append(F.round(F.coalesce("fill_opacity", F.lit(1.0)), 3))
    return first_of_equal(boxes, keys, ["ord"])


def numbered_boxes(boxes: DataFrame, prefix: str = "c") -> DataFrame:
    """With ``n`` from 0 and ``id`` (p<page>_<prefix><n>): a page's boxes by area, x, y and fill."""
    w = Window.partitionBy("page_id").orderBy((F.col("w") * F.col("h")).asc(), "x", "y", "fill", "ord")
    n = (F.row_number().over(w) - 1).cast("long")
    return boxes.withColumn("n", n).withColumn("id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(f"_{prefix}"), n.cast("string")))


def _best_of_each(left: DataFrame, right: DataFrame, condition: Callable[[DataFrame], Column], value: Column, order: Column) -> DataFrame:
    """left with ``_best``: the value of the first match in order, null without one. Rows that are alike keep a row each: they're told apart
    by a number, and as the page clusters them already, grouping by page and number takes no further shuffle."""
    rows = left.withColumn("_row", F.monotonically_increasing_id())
    joined = rows.join(right, condition(rows), "left")
    kept = [F.first(c).alias(c) for c in left.columns if c != "page_id"]
    return joined.groupBy("page_id", "_row").agg(*kept, F.min_by(value, order).alias("_best")).select(*left.columns, "_best")


def smallest_box_at(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points (page_id, point_id, left, top) with ``box_id``: the smallest box of the page that holds the point, edges included, the
    first in order of equal ones; null without one. Points without a place match nothing; one with a ``container`` keeps that."""
    b = boxes.select(F.col("page_id").alias("_page"), F.col("ord").alias("_ord"), F.col("id").alias("_id"), "x", "y", "w", "h")

    def inside(rows: DataFrame) -> Column:
        return (rows["page_id"] == b["_page"]) & rows["left"].between(b["x"], b["x"] + b["w"]) & rows["top"].between(b["y"], b["y"] + b["h"])

    found = _best_of_each(points, b, inside, F.col("_id"), F.struct((F.col("w") * F.col("h")).alias("a"), "_ord", "_id"))
    box = F.coalesce("container", "_best") if "container" in points.columns else F.col("_best")
    return found.select(*points.columns, box.alias("box_id"))


def nearest_entry(boxes: DataFrame, entries: DataFrame, limit: float = NEAREST_LIMIT) -> DataFrame:
    """boxes (page_id, box_id, x0, y0, x1, y1) with ``xref`` and ``distance``: the entry of the page with the least sum of coordinate
    differences, the first of equals; both null beyond the limit."""
    e = entries.select(F.col("page_id").alias("_page"), F.col("ord").alias("_ord"), F.col("xref").alias("_xref"), *(F.col(c).alias(f"e{c}") for c in ("x0", "y0", "x1", "y1")))
    distance = sum((F.abs(F.col(c) - F.col(f"e{c}")) for c in ("y0", "x1", "y1")), F.abs(F.col("x0") - F.col("ex0")))
    best = _best_of_each(boxes, e, lambda rows: rows["page_id"] == e["_page"], F.struct("_xref", distance.alias("_d")), F.struct(distance.alias("d"), "_ord"))
    near = F.col("_best._d") <= limit
    return best.select(*boxes.columns, F.when(near, F.col("_best._xref")).alias("xref"), F.when(near, F.col("_best._d")).alias("distance"))


def palettes(boxes: DataFrame, fills: int = PALETTE_FILLS) -> DataFrame:
    """page_id, primary and fills: a page's colours by their area, the largest first, the first seen of equals."""
    total = boxes.where("fill is not null and fill <> ''").groupBy("page_id", "fill").agg(F.sum(F.col("w") * F.col("h")).alias("a"), F.min("ord").alias("o"))
    # Sums of doubles differ in their last digits with the order of rows; rounded, equal areas tie.
    w = Window.partitionBy("page_id").orderBy(F.round("a", 3).desc(), "o", "fill")
    top = total.withColumn("n", F.row_number().over(w)).where(F.col("n") <= fills)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "fill"))), lambda s: s["fill"])
    return top.groupBy("page_id").agg(listed.alias("fills")).select("page_id", F.col("fills")[0].alias("primary"), "fills")


def split_by_container(lines: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines in a container of their page, the other lines); lines: page_id, container."""
    known = boxes.select("page_id", F.col("id").alias("container")).distinct()
    return lines.join(known, ["page_id", "container"], "left_semi"), lines.join(known, ["page_id", "container"], "left_anti")


def style_dictionary(spans: DataFrame, style: Column, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(spans with ``ts``, the dictionary (ts, style)): a document's styles numbered by first occurrence.

    spans: doc_id and what orders them. A null or empty style has no number."""
    keyed = spans.withColumn("_style", style)
    first = keyed.where("_style is not null and _style <> ''").groupBy("doc_id", "_style").agg(F.min(F.struct(*order)).alias("_at"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")) - 1
    names = first.select("doc_id", "_style", F.concat(F.lit("ts"), number.cast("string")).alias("ts"))
    return keyed.join(names, ["doc_id", "_style"], "left").drop("_style"), names.withColumnRenamed("_style", "style")


def distinct_faces(fonts: DataFrame, name: str, order: list[str]) -> DataFrame:
    """fonts with family, weight and style of their names, the first of each three in order."""
    rows = fonts.withColumn("_face", text.font_face(F.col(name))).where("_face is not null")
    first = first_of_equal(rows, [F.col("_face")], order)
    return first.select(*fonts.columns, "_face.family", "_face.weight", "_face.style")


def content_addressed(rows: DataFrame, content: Column, extension: Column, order: list[str]) -> DataFrame:
    """One row per distinct content: ``name`` (sixteen hexadecimal digits of its SHA-1 and the extension), copies, and the first row's
    order columns."""
    named = rows.withColumn("name", F.concat(F.substring(F.sha1(content), 1, 16), extension))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*order)).alias("first")).select("name", "copies", "first.*")


#: Pixels and channels that an image must have to count as a shadow, samples that are looked at, and how far they differ
#: and how bright they are at most.
SHADOW_PIXELS, SHADOW_CHANNELS, SHADOW_SAMPLES, SHADOW_SPREAD, SHADOW_BRIGHTEST = 20_000, 3, 2048, 24, 40


def channel_extremes(pixels: Column, width: Column, height: Column, channels: Column) -> Column:
    """struct(least, most) of the red, green and blue values of about 2048 pixels at equal steps; nulls where the bytes fall short. pixels:
    binary, ``channels`` bytes a pixel. Single bytes out of a large binary are what the JVM's expressions copy all of it for, so
    this runs in Arrow batches."""

    def extremes(pixels: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.DataFrame:
        out = []
        for data, w, h, n in zip(pixels, width, height, channels, strict=True):
            total = 0 if data is None or pd.isna(w) or pd.isna(h) or pd.isna(n) else int(w) * int(h)
            if not total or len(data) < total * int(n) or n < SHADOW_CHANNELS:
                out.append((None, None))
                continue
            values = np.frombuffer(data, np.uint8)[: total * int(n)].reshape(total, int(n))[:: max(1, total // SHADOW_SAMPLES), :3]
            out.append((int(values.min()), int(values.max())))
        return pd.DataFrame(out, columns=["least", "most"]).astype("Int32")

    return F.pandas_udf(extremes, "least int, most int")(pixels, width, height, channels)


def shadow_like(extremes: Column, width: Column, height: Column) -> Column:
    """Whether an image is a shadow's mask: large, and its sampled channel values (least, most) nearly one dark value."""
    like = (extremes["most"] - extremes["least"] <= SHADOW_SPREAD) & (extremes["most"] <= SHADOW_BRIGHTEST)
    return F.coalesce(like & (width * height >= SHADOW_PIXELS), F.lit(False))


def image_boxes(blocks: DataFrame, entries: DataFrame, page_area: Column) -> DataFrame:
    """Image blocks that are images of a page, numbered: page_id, id (p<page>_i<n>), name (<nn>.png), x, y, w, h, xref, has_mask, image, ext.

    blocks: page_id, ord, x0, y0, x1, y1, image (binary), ext; entries: the page's drawn images (page_id, ord, x0, y0, x1, y1, xref,
    has_mask, and pixels, width, height, channels where they're known). Blocks without bytes go, and such as don't fit; one of each place
    and size stays; one that is drawn through a mask and looks like a shadow goes."""
    sized = blocks.withColumn("x", F.col("x0")).withColumn("y", F.col("y0")).withColumn("w", F.greatest(F.lit(0.0), F.col("x1") - F.col("x0"))).withColumn("h", F.greatest(F.lit(0.0), F.col("y1") - F.col("y0")))
    kept = distinct_boxes(sized.where(F.col("image").isNotNull() & geometry.fits(F.col("w"), F.col("h"), page_area)), by_fill=False)
    masked = [F.when(F.col("has_mask"), F.col("pixels")).alias("_pixels")]
    drawn = entries.select("page_id", F.col("xref").alias("_xref"), *masked, *(F.col(c).alias(f"_{c}") for c in ("has_mask", "width", "height", "channels"))).dropDuplicates(["page_id", "_xref"])
    found = nearest_entry(kept, entries).drop("distance")
    found = found.join(drawn.withColumnRenamed("page_id", "_page"), (F.col("page_id") == F.col("_page")) & (F.col("xref") == F.col("_xref")), "left")
    size = [F.col(c) for c in ("_width", "_height", "_channels")]
    found = found.withColumn("_extremes", channel_extremes(F.col("_pixels"), *size))
    shadow = F.coalesce("_has_mask", F.lit(False)) & shadow_like(F.col("_extremes"), *size[:2])
    w = Window.partitionBy("page_id").orderBy("ord")
    n = (F.row_number().over(w) - 1).cast("long")
    rows = found.where(~shadow).withColumn("_n", n)
    name = F.concat(F.format_string("%02d", "_n"), F.lit(".png"))
    return rows.select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("_i"), F.col("_n").cast("string")).alias("id"), name.alias("name"), "x", "y", "w", "h", "xref", F.col("_has_mask").alias("has_mask"), "image", "ext")


def decoded_images(images: DataFrame, decoders: Sequence[Callable[[dict], bytes | None]]) -> DataFrame:
    """images (name, image, ext and others) with ``name`` and ``content``: what the first decoder gives that gives anything. A decoder that
    fails gives nothing; without any the raw bytes stay, under a name with their own extension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            contents = []
            for row in b.to_dict("records"):
                found = None
                for decode in decoders:
                    try:
                        found = decode(row)
                    except Exception:  # the next one may know the format
                        found = None
                    if found:
                        break
                contents.append(found or None)
            yield b.assign(_decoded=contents)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields), "_decoded binary"])
    ship(images.sparkSession)
    rows = images.mapInPandas(run, schema)
    raw = F.concat(F.regexp_replace("name", r"\.[^.]*$", "."), text.safe_filename(F.lower(F.coalesce(text.present(F.trim("ext")), F.lit("bin")))))
    return rows.withColumn("name", F.when(F.col("_decoded").isNull(), raw).otherwise(F.col("name"))).withColumn("content", F.coalesce("_decoded", "image")).drop("_decoded")


def narrowest_range(points: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """points (key, point_id, at) with ``name``: the narrowest range of the key that holds ``at``, the first name of equals."""
    r = ranges.select(F.col(key).alias("_key"), "low", "high", F.col("name").alias("_name"))
    rows = points.withColumnRenamed(key, "page_id")

    def holds(left: DataFrame) -> Column:
        return (left["page_id"] == r["_key"]) & left["at"].between(r["low"], r["high"])

    found = _best_of_each(rows, r, holds, F.col("_name"), F.struct((F.col("high") - F.col("low")).alias("width"), "_name"))
    return found.withColumnRenamed("page_id", key).select(*points.columns, F.col("_best").alias("name"))
