"""A page's plan from its markup: palette, images, groups of text in containers and floating text, without coordinates.

A page is one record, and all of it happens within the record: higher-order functions over its arrays, no join and no shuffle.
What a page holds bounds the arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import geometry, text
from leafmill.operators import assemble, blocks, boxes
from leafmill.sources import markup, tables

#: Fixed value: how the id of a floating group begins.
FLOATING = "floating:"


def style_rules(css: Column) -> Column:
    """array<struct(ts, font_size_pt, color)> of a style sheet's .tsN rules; of repeated ones the last counts."""
    rules = F.regexp_extract_all(css, F.lit(r"(\.ts\d+\s*\{[^}]*\})"), F.lit(1))

    def rule(r: Column) -> Column:
        size = text.present(F.regexp_extract(r, r"font-size:([0-9.]+)pt", 1)).try_cast("double")
        color = F.when(r.rlike("color:[^;]+;"), text.strip(F.regexp_extract(r, r"color:([^;]+);", 1)))
        return F.struct(F.regexp_extract(r, r"\.(ts\d+)", 1).alias("ts"), size.alias("font_size_pt"), color.alias("color"))

    return F.transform(rules, rule)


def styled_runs(runs: Column, styles: Column) -> Column:
    """array<struct(text, bold, color, font_size_pt)>: blank runs go, the others have their class's style, and neighbours of one style
    are one. A class without a rule has no style."""

    def styled(r: Column) -> Column:
        rule = F.get(F.filter(F.reverse(styles), lambda s: s["ts"] == r["ts"]), F.lit(0))
        return F.struct(r["text"].alias("text"), r["bold"].alias("bold"), rule["color"].alias("color"), rule["font_size_pt"].alias("font_size_pt"))

    some = F.transform(F.filter(runs, lambda r: text.strip(r["text"]) != ""), styled)
    none = F.array().cast("array<struct<text: string, bold: boolean, color: string, font_size_pt: double>>")

    def merged(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & (last["bold"] == r["bold"]) & last["color"].eqNullSafe(r["color"]) & last["font_size_pt"].eqNullSafe(r["font_size_pt"])
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(last.withField("text", F.concat(last["text"], r["text"]))))
        return F.when(F.coalesce(same, F.lit(False)), longer).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(some, none, lambda done, r: merged(F.when(F.size(done) > 0, done).otherwise(none), r))


def page_lines(lines: Column, styles: Column) -> Column:
    """Lines for the folds: ord, text, kind, left, top, lh, container. A line's text is that of its runs; a bullet that a later run begins
    with stands in front. Lines that say nothing go."""

    def line(x: Column, runs: Column) -> Column:
        bullet = text.strip_leading_bullet(runs)
        plain = F.array_join(F.transform(bullet["runs"], lambda r: r["text"]), "")
        place = [F.coalesce(text.style_pt(x["style"], k), F.lit(0.0)).alias(n) for k, n in (("top", "top"), ("left", "left"))]
        lh = F.coalesce(text.style_pt(x["style"], "line-height"), F.lit(0.0)).alias("lh")
        spelled = F.when(bullet["removed"], F.concat(F.lit(text.BULLETS[1]), plain)).otherwise(plain)
        return F.struct(*place, x["ord"].alias("ord"), spelled.alias("text"), text.block_kind_of_runs(runs).alias("kind"), lh, x["container"].alias("container"), text.plain_text(runs).alias("_plain"))

    both = F.transform(lines, lambda x: F.struct(x.alias("x"), styled_runs(x["runs"], styles).alias("runs")))
    found = F.transform(both, lambda b: line(b["x"], b["runs"]))
    return F.filter(found, lambda x: ~text.says_nothing(x["_plain"]))


def folded(lines: Column, tolerance: float, placement: Column) -> Column:
    """The blocks of lines: array<struct(kind, text, items, placement)>."""
    sorted_ = F.array_sort(F.transform(lines, lambda x: x.dropFields("container", "_plain")))
    return F.transform(blocks.blocks_of(sorted_, tolerance), lambda b: F.struct(b["kind"].alias("kind"), F.when(b["kind"] != "bullets", b["text"]).alias("text"), F.when(b["kind"] == "bullets", b["items"]).alias("items"), placement.alias("placement")))


def palette(containers: Column) -> Column:
    """struct(primary, fills): the colours by their area, the largest first, the first seen of equals; null without one."""
    colored = F.filter(containers, lambda c: F.coalesce(c["fill"], F.lit("")) != "")
    fills = F.array_distinct(F.transform(colored, lambda c: c["fill"]))

    def share(fill: Column, at: Column) -> Column:
        own = F.transform(F.filter(colored, lambda c: c["fill"] == fill), lambda c: geometry.area(c["w"], c["h"]))
        return F.struct((-F.aggregate(own, F.lit(0.0), lambda a, x: a + x)).alias("a"), at.alias("at"), fill.alias("fill"))

    ranked = F.transform(F.array_sort(F.transform(fills, share)), lambda s: s["fill"])
    return F.when(F.size(fills) > 0, F.struct(ranked[0].alias("primary"), F.slice(ranked, 1, boxes.PALETTE_FILLS).alias("fills")))


def planned_pages(documents: DataFrame, key: str, html: str, css: str, sourceless: str = "error") -> DataFrame:
    """key, page, page_id, layout_notes (empty), palette, images, groups and floating_groups of each page of documents with a style sheet.

    images: id, src, placement, size, and display_scale, display_w_pt and display_h_pt of such as have a size. One without a source is an
    error, or goes (sourceless="skip"). groups: of containers with text, from the top, then the left: group_id, placement, size, fill and
    blocks; floating_groups: lines outside, by the place of their corner: group_id, placement and blocks."""
    if sourceless not in ("error", "skip"):
        raise ValueError(f"sourceless: {sourceless}")
    rows = markup.page_records(documents.select(key, html, F.coalesce(css, F.lit("")).alias("_css")), key, html, "_css")
    rows = rows.withColumn("_size", tables.page_size(F.col("_css"))).withColumn("_lines", page_lines(F.col("lines"), style_rules(F.col("_css"))))
    pw, ph = F.col("_size.w"), F.col("_size.h")

    def place(b: Column) -> Column:
        return geometry.placement(b["x"], b["y"], b["w"], b["h"], pw, ph)

    def bucket(b: Column) -> Column:
        return geometry.size_bucket(b["w"], b["h"], pw, ph)

    def image(i: Column) -> Column:
        shown = (i["w"] > 0) & (i["h"] > 0)
        sizes = [F.when(shown, v).alias(n) for v, n in ((F.lit(geometry.DISPLAY_SCALE), "display_scale"), (geometry.display_size(i["w"]), "display_w_pt"), (geometry.display_size(i["h"]), "display_h_pt"))]
        return F.struct(i["id"].alias("id"), i["src"].alias("src"), place(i).alias("placement"), bucket(i).alias("size"), *sizes)

    lacking = F.get(F.filter("images", lambda i: i["src"].isNull()), F.lit(0))
    images = F.transform(F.filter("images", lambda i: i["src"].isNotNull()), image)
    if sourceless == "error":
        images = F.when(lacking.isNotNull(), F.raise_error(F.concat(F.lit("image without data-src: "), lacking["id"])).cast("array<struct<id: string, src: string, placement: string, size: string, display_scale: double, display_w_pt: double, display_h_pt: double>>")).otherwise(images)

    ids = F.transform("containers", lambda c: c["id"])
    known = F.filter("containers", lambda c, n: ~F.array_contains(F.slice(ids, n + 2, F.size(ids)), c["id"]))  # of a repeated id the last counts

    def group(c: Column) -> Column:
        lines = F.filter("_lines", lambda x: x["container"] == c["id"])
        first = F.array_min(F.transform(lines, lambda x: x["ord"]))
        return F.struct(c["y"].alias("y"), c["x"].alias("x"), first.alias("first"), c["id"].alias("group_id"), place(c).alias("placement"), bucket(c).alias("size"), c["fill"].alias("fill"), folded(lines, blocks.LEFT_TOLERANCE, place(c)).alias("blocks"))

    groups = F.transform(F.array_sort(F.filter(F.transform(known, group), lambda g: g["first"].isNotNull())), lambda g: g.dropFields("y", "x", "first"))

    floating = F.filter("_lines", lambda x: x["container"].isNull() | ~F.array_contains(ids, x["container"]))
    corner = F.transform(floating, lambda x: F.struct(geometry.placement_of_corner(x["left"], x["top"], pw, ph).alias("placement"), x.alias("line")))
    places = F.array_sort(F.array_distinct(F.transform(corner, lambda x: x["placement"])))

    def floating_group(p: Column) -> Column:
        lines = F.transform(F.filter(corner, lambda x: x["placement"] == p), lambda x: x["line"])
        return F.struct(F.concat(F.lit(FLOATING), p).alias("group_id"), p.alias("placement"), folded(lines, blocks.FLOATING_TOLERANCE, p).alias("blocks"))

    floating_groups = F.filter(F.transform(places, floating_group), lambda g: F.size(g["blocks"]) > 0)
    return rows.select(key, "page", "page_id", F.lit("").alias("layout_notes"), palette(F.col("containers")).alias("palette"), images.alias("images"), groups.alias("groups"), floating_groups.alias("floating_groups"))


def named_images(pages: DataFrame, asked: DataFrame, described: DataFrame) -> DataFrame:
    """page_id, images and featured of pages (page_id, images: array of (src, placement, size, display_scale, display_w_pt, display_h_pt)): images
    in the order asked for, then the others; each with its name (image1, image2 and so on), the size that it was drawn at, and its
    description, empty without one. asked: page_id, srcs; described: page_id, src, text, one each.

    Pages without images have none and no featured one; it is the image shown largest, the first of equals."""
    own = F.array_distinct(F.filter(F.transform("images", lambda i: i["src"]), lambda s: F.coalesce(s, F.lit("")) != ""))
    rows = pages.join(asked.select("page_id", "srcs"), "page_id", "left").withColumn("_own", own)
    order = assemble.ordered_merge(F.coalesce("srcs", F.array().cast("array<string>")), F.col("_own"))
    texts = described.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("src", "text"))).alias("_texts"))
    rows = rows.withColumn("_order", order).join(texts, "page_id", "left")

    def image(src: Column, n: Column) -> Column:
        i = F.element_at(F.filter("images", lambda i: i["src"] == src), -1)  # of a repeated source the last counts
        drawn = [F.round(i[c] / F.nullif(i["display_scale"], F.lit(0.0)), 2).alias(a) for c, a in (("display_w_pt", "ref_w_pt"), ("display_h_pt", "ref_h_pt"))]
        name = F.concat(F.lit("image"), (n + 1).cast("string")).alias("name")
        return F.struct(name, src.alias("src"), *(i[c].alias(c) for c in ("placement", "size", "display_w_pt", "display_h_pt")), *drawn, F.coalesce(F.try_element_at("_texts", src), F.lit("")).alias("description"))

    rows = rows.withColumn("_named", F.transform("_order", image))
    areas = F.array_sort(F.transform("_named", lambda i, n: F.struct((-geometry.area(i["display_w_pt"], i["display_h_pt"])).alias("a"), n.alias("n"), i["name"].alias("name"))))
    return rows.select("page_id", F.col("_named").alias("images"), F.get(areas, F.lit(0))["name"].alias("featured"))


def required_references(images: Column, paragraphs: Column) -> Column:
    """struct(images, text_paragraphs, all): the names that a page must refer to, images first. images, paragraphs: arrays with a name."""

    def names(c: Column) -> Column:
        found = F.filter(F.transform(c, lambda x: x["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
        return F.coalesce(found, F.array().cast("array<string>"))

    own, text_ = names(images), names(paragraphs)
    return F.struct(own.alias("images"), text_.alias("text_paragraphs"), F.concat(own, text_).alias("all"))


def described_pages(pages: DataFrame) -> DataFrame:
    """The pages that have an image to describe."""
    return pages.where(F.size("images") > 0)


def pages_with_notes(meta: DataFrame, notes: DataFrame, first: int, page: str = "page") -> DataFrame:
    """meta with ``layout_notes`` of the pages that have both; an error if the first page has not."""
    both = meta.join(notes.select(page, text.strip(F.col("notes")).alias("layout_notes")), page)
    if both.where(F.col(page) == first).isEmpty():
        raise ValueError(f"missing inputs for page {first}")
    return both


def manifest(pages: DataFrame, document: str, page: str = "page") -> DataFrame:
    """document, page_count and pages (their records in order) of rendered pages."""
    others = [c for c in pages.columns if c not in (document, page)]
    listed = F.array_sort(F.collect_list(F.struct(page, *others)))
    return pages.groupBy(document).agg(F.count(F.lit(1)).alias("page_count"), listed.alias("pages"))
