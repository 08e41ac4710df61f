"""Ordered folds: runs of one style, paragraphs and bullet lists from a page's lines.

A paragraph's lines are held against its first line, so neighbours alone don't decide and a window with lag can't
express it: the lines of a group are sorted into an array, whose length a page bounds, and folded by ``aggregate``.
All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text

#: How far a line may stand from its paragraph's first line, in a group and outside; the gap between lines in line
#: heights; how far a bullet's further lines stand in.
LEFT_TOLERANCE, FLOATING_TOLERANCE, GAP, INDENT = 3.0, 8.0, 1.9, 8.0


def merged_runs(runs: DataFrame, keys: list[str], order: str, style: list[str]) -> DataFrame:
    """Neighbouring runs of one style as one: keys, run (from 0), the style and text. Runs of white space only go first."""
    kept = runs.where(text.strip(F.coalesce(F.col("text"), F.lit(""))) != "")
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.lit(True)
    for s in style:
        same = same & F.col(s).eqNullSafe(F.lag(s).over(w))
    number = F.sum(F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1)).over(w)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda r: r["text"]), "")
    return kept.withColumn("run", number - 1).groupBy(*keys, "run", *style).agg(joined.alias("text"))


_BLOCK = "struct<kind: string, text: string, items: array<string>, left: double, top: double, lh: double>"


def _fold(lines: Column, tolerance: float) -> Column:
    """The blocks of sorted lines (text, kind, left, top, lh): struct(done, open), the open block last."""

    def block(line: Column, bullet: Column) -> Column:
        item = text.without_bullet(line["text"])
        return F.struct(
            F.when(bullet, F.lit("bullets")).otherwise(line["kind"]).alias("kind"),
            F.when(~bullet, line["text"]).alias("text"),
            F.when(bullet, F.array(item)).otherwise(F.array().cast("array<string>")).alias("items"),
            line["left"].alias("left"),
            line["top"].alias("top"),
            line["lh"].alias("lh"),
        )

    def step(state: Column, line: Column) -> Column:
        b = state["open"]
        bullet = text.is_bullet(line["text"])
        list_open = F.coalesce(b["kind"] == "bullets", F.lit(False))
        new_item = list_open & bullet
        continues_item = list_open & ~bullet & (line["left"] >= b["left"] + INDENT)
        paragraph = (
            b.isNotNull()
            & ~list_open
            & ~bullet
            & ~b["kind"].isin("title", "heading")
            & (b["kind"] == line["kind"])
            & (F.abs(line["left"] - b["left"]) <= tolerance)
            & ~((b["lh"] != 0) & (line["top"] - b["top"] > b["lh"] * GAP))
            & ~text.normalize(b["text"]).rlike(f"[{text.TERMINATORS}]$")
        )
        paragraph = F.coalesce(paragraph, F.lit(False))
        last = F.size(b["items"])
        grown = F.when(
            new_item,
            b.withField("items", F.concat(b["items"], F.array(text.without_bullet(line["text"])))),
        ).when(
            continues_item,
            b.withField("items", F.concat(F.slice(b["items"], F.lit(1), last - 1), F.array(text.joined(F.element_at(b["items"], -1), line["text"])))),
        )
        merged = b.withField("text", text.joined(b["text"], line["text"])).withField("top", line["top"]).withField("lh", F.when(line["lh"] != 0, line["lh"]).otherwise(b["lh"]))
        goes_on = new_item | continues_item | paragraph
        return F.struct(
            F.when(goes_on | b.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(b))).alias("done"),
            F.when(new_item | continues_item, grown).when(paragraph, merged).otherwise(block(line, bullet)).cast(_BLOCK).alias("open"),
        )

    start = F.struct(F.array().cast(f"array<{_BLOCK}>").alias("done"), F.lit(None).cast(_BLOCK).alias("open"))
    end = F.aggregate(lines, start, step)
    return F.when(F.size(lines) > 0, F.concat(end["done"], F.array(end["open"]))).otherwise(end["done"])


def folded_blocks(lines: DataFrame, keys: list[str], tolerance: float = LEFT_TOLERANCE) -> DataFrame:
    """keys, block (from 0), kind, text and items of each group of lines. lines: keys, ord, text, kind, left, top, lh.

    Lines go by (top, left, ord). A paragraph ends before a bullet, another kind, a line that stands off its first line's left, a gap
    of more than 1.9 line heights, and after a terminator; titles and headings are one line each. A bullet begins an
    item; lines that stand in by 8 or more continue it, and neighbouring items are one block. Missing numbers are 0,
    and a line height of 0 leaves the last one. Empty items and texts go.
    """
    zero = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("top", "left")]
    line = F.struct(*zero, "ord", F.coalesce("text", F.lit("")).alias("text"), "kind", F.coalesce(F.col("lh").cast("double"), F.lit(0.0)).alias("lh"))
    grouped = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    exploded = grouped.select(*keys, F.posexplode(blocks_of(F.col("lines"), tolerance)).alias("block", "b"))
    return exploded.select(*keys, F.col("block").cast("long").alias("block"), "b.kind", F.when(F.col("b.kind") != "bullets", F.col("b.text")).alias("text"), "b.items")


def blocks_of(lines: Column, tolerance: float) -> Column:
    """The blocks (kind, text, items) of an array of lines (top, left, ord, text, kind, lh) in order, without empty ones."""
    blocks = F.transform(
        _fold(lines, tolerance),
        lambda b: F.struct(b["kind"].alias("kind"), text.normalize(b["text"]).alias("text"), F.filter(F.transform(b["items"], text.normalize), lambda i: i != "").alias("items")),
    )
    return F.filter(blocks, lambda b: F.when(b["kind"] == "bullets", F.size(b["items"]) > 0).otherwise(b["text"] != ""))
