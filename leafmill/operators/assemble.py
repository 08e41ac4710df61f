"""Assembly of a page's record from fragments, paragraphs, images and their descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text

#: Block kinds by priority, and what a page's text needs.
KIND_PRIORITY = ("title", "heading", "subheading", "label", "bullet_item", "body")
ZH_PER_LINE, EN_PER_LINE, LEAST_TEXT_SHARE, MOST_IMAGE_SHARE, LONG_LINES = 28.0, 55.0, 0.35, 0.85, 30.0


def tagged_union(parts: dict[str, DataFrame], tag: str, rank: str) -> DataFrame:
    """All rows of the parts with the part's name and its rank in the given order."""
    tagged = [df.withColumn(tag, F.lit(name)).withColumn(rank, F.lit(i).cast("long")) for i, (name, df) in enumerate(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def fragment_ids(fragments: DataFrame, page: str, order: list[str], prefix: str = "t") -> DataFrame:
    """Fragments with text, with ``fragment_no`` from 1 in the page's order and ``fragment_id``."""
    kept = fragments.where(F.length(text.strip(F.coalesce(F.col("text"), F.lit("")))) > 0)
    number = F.row_number().over(Window.partitionBy(page).orderBy(*order)).cast("long")
    return kept.withColumn("fragment_no", number).withColumn("fragment_id", F.concat(F.lit(prefix), number.cast("string")))


def exploded_blocks(pages: DataFrame) -> DataFrame:
    """Fragments of pages (page_id, groups: array of (group_id, placement, blocks)): one per text block and per bullet item.

    Order columns: group_no, block_no, item_no."""
    groups = pages.select("page_id", F.posexplode("groups").alias("group_no", "g")).select("page_id", "group_no", "g.group_id", "g.placement", F.posexplode("g.blocks").alias("block_no", "b"))
    items = F.when(F.col("b.kind") == "bullets", F.col("b.items")).otherwise(F.array("b.text"))
    rows = groups.select("page_id", "group_no", "group_id", "placement", "block_no", "b.kind", F.posexplode(items).alias("item_no", "text"))
    return rows.withColumn("kind", F.when(F.col("kind") == "bullets", "bullet_item").otherwise(F.col("kind")))


def paragraph_hints(paragraphs: DataFrame, fragments: DataFrame) -> DataFrame:
    """paragraphs (page_id, paragraph, sources) with ``kind_hint``, the first by priority of its sources' kinds or "body", and
    ``placement_hints``, their distinct placements in order. Unknown sources tell nothing."""
    rows = paragraphs.select("page_id", "paragraph", F.posexplode_outer("sources").alias("pos", "fragment_id"))
    joined = rows.join(fragments.select("page_id", "fragment_id", "kind", "placement"), ["page_id", "fragment_id"], "left")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KIND_PRIORITY)), F.col("kind")), F.lit(0)), F.lit(len(KIND_PRIORITY)))
    listed = F.array_sort(F.collect_list(F.when(F.col("placement") != "", F.struct("pos", "placement"))))
    out = joined.groupBy("page_id", "paragraph").agg(F.min(rank).alias("_r"), listed.alias("_p"))
    kind = F.element_at(F.array(*map(F.lit, KIND_PRIORITY)), F.col("_r").cast("int"))
    return out.select("page_id", "paragraph", kind.alias("kind_hint"), F.array_distinct(F.transform("_p", lambda p: p["placement"])).alias("placement_hints"))


def with_first_of(left: DataFrame, key: list[str], sources: list[tuple[DataFrame, str]], default: Column, out: str) -> DataFrame:
    """left with ``out``: the first source's value that isn't null, else default. Sources have the key once."""
    names = []
    for i, (df, value) in enumerate(sources):
        names.append(f"_v{i}")
        left = left.join(df.select(*key, F.col(value).alias(names[-1])), key, "left")
    return left.withColumn(out, F.coalesce(*names, default)).drop(*names)


def ordered_merge(first: Column, second: Column) -> Column:
    """The first list's elements that the second has, in the first's order, then the second's others; an empty first: the second."""
    return F.array_union(F.array_intersect(first, second), second)


def text_statistics(paragraphs: DataFrame) -> DataFrame:
    """page_id, zh_chars, en_chars, paragraphs: code points without the white space at the ends."""
    size = {c: F.sum(F.length(text.strip(F.coalesce(F.col(c), F.lit(""))))).cast("long") for c in ("zh", "en")}
    return paragraphs.groupBy("page_id").agg(size["zh"].alias("zh_chars"), size["en"].alias("en_chars"), F.count(F.lit(1)).alias("paragraphs"))


def page_load(statistics: DataFrame) -> DataFrame:
    """statistics (page_id, zh_chars, en_chars, image_area, page_area) with image_ratio, text_ratio, estimated_lines, effective_lines and
    long_text."""
    image = F.least(F.lit(MOST_IMAGE_SHARE), F.greatest(F.lit(0.0), F.coalesce("image_area", F.lit(0.0)) / F.greatest(F.lit(1.0), F.col("page_area"))))
    share = F.greatest(F.lit(LEAST_TEXT_SHARE), 1 - image)
    lines = F.col("zh_chars") / ZH_PER_LINE + F.col("en_chars") / EN_PER_LINE
    return (
        statistics.withColumn("image_ratio", F.round(image, 4))
        .withColumn("text_ratio", F.round(share, 4))
        .withColumn("estimated_lines", F.round(lines, 2))
        .withColumn("effective_lines", F.round(lines / share, 2))
        .withColumn("long_text", lines / share >= LONG_LINES)
    )


def featured(images: DataFrame, page: str = "page_id") -> DataFrame:
    """page, featured: the name of the page's largest image, the first of equals. images: page, ord, name, w, h."""
    size = F.coalesce("w", F.lit(0.0)) * F.coalesce("h", F.lit(0.0))
    return images.groupBy(page).agg(F.max_by("name", F.struct(size, -F.col("ord"))).alias("featured"))


def joined_pages(parts: DataFrame, document: str, number: str, part: str) -> DataFrame:
    """document and html: its parts in the order of their numbers, one below the other."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(part).alias("p"))))
    return parts.groupBy(document).agg(F.array_join(F.transform(listed, lambda s: s["p"]), "\n").alias("html"))


def with_block_replaced(whole: Column, start: str, end: str, block: Column) -> Column:
    """whole with what stands between the first start and end sign replaced; an error where a sign is missing. The block is taken as it
    is: backslashes and dollar signs mean themselves."""
    a = F.instr(whole, start)
    b = F.locate(end, whole, 1)
    after = F.instr(F.substring(whole, a + F.lit(len(start)), F.length(whole)), end)
    head = F.substring(whole, F.lit(1), a + F.lit(len(start) - 1))
    tail = F.substring(whole, a + F.lit(len(start)) + after - 1, F.length(whole))
    return F.when((a > 0) & (after > 0) & (b > 0), F.concat(head, block, tail)).otherwise(F.raise_error(F.lit("page markers are missing")))
