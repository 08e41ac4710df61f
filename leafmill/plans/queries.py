"""The library's queries over the tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry, text
from leafmill.operators import assemble, blocks, boxes, validate
from leafmill.plans import literal, paging
from leafmill.plans.derived import BOXES_SQL, LINES_SQL, NORMAL_SQL, PAGE_H, PAGE_W, PLACE_SQL, derived_boxes, derived_lines
from leafmill.sources import tables
from leafmill.streaming import jobs

def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_lines(tables.table(spark, sf_dir, "documents"))


# ---- Text


def norm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments and characters of each document: lines, normalised, without noise."""
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    rows = rows.select("doc_id", text.normalize(F.col("line")).alias("t")).where(~text.says_nothing(F.col("t")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fragments"), F.sum(F.length("t")).cast("long").alias("chars"), F.sum(text.has_latin(F.col("t")).cast("long")).alias("latin"))


NORM_LINES_SQL = rf"""
WITH l AS (SELECT doc_id, {NORMAL_SQL.format(c="unnest(string_split(text, chr(10)))")} AS t FROM documents)
SELECT doc_id, count(*) AS fragments, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(CASE WHEN regexp_matches(t, '[A-Za-z]') THEN 1 ELSE 0 END) AS BIGINT) AS latin
FROM l WHERE t <> '' AND NOT regexp_full_match(t, '[\s\.:。·•●⚫…，,、;；!！?？\-—_]+') GROUP BY doc_id
"""


def page_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 10 to 49 with the length of their markup and whether they are complete."""
    rows = tables.page_range(tables.table(spark, sf_dir, "pages"), 10, 49, "page_id")
    return rows.select("page_id", "url", F.length("html").cast("long").alias("html_chars"), F.contains(F.lower("html"), F.lit("</html>")).alias("complete"))


PAGE_RANGE_SQL = "SELECT page_id, url, length(html) AS html_chars, contains(lower(html), '</html>') AS complete FROM pages WHERE page_id BETWEEN 10 AND 49"


def block_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the kind that their font size and weight say: size and weight come from the line's length and order."""
    size, bold = 12.0 + (F.length("text") % 40), F.col("ord") % 2 == 0
    rows = _lines(spark, sf_dir).select("doc_id", text.block_kind(size.cast("double"), bold).alias("block_kind"))
    return rows.groupBy("doc_id", "block_kind").agg(F.count(F.lit(1)).alias("n"))


BLOCK_CLASS_SQL = f"""
WITH {LINES_SQL}, s AS (SELECT doc_id, 12 + length(text) % 40 AS fs, ord % 2 = 0 AS bold FROM lines)
SELECT doc_id, CASE WHEN fs >= 40 THEN 'title' WHEN fs >= 30 THEN 'heading' WHEN fs >= 22 AND bold THEN 'subheading' WHEN fs >= 20 AND bold THEN 'label' ELSE 'body' END AS block_kind, count(*) AS n
FROM s GROUP BY 1, 2
"""

# ---- Geometry

def placement_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    pw, ph = F.lit(PAGE_W), F.lit(PAGE_H)
    x, y, w, h = (F.col(c) for c in "xywh")
    return derived_boxes(spark, sf_dir).select(
        "page_id", "ord", geometry.placement(x, y, w, h, pw, ph).alias("placement"), geometry.size_bucket(w, h, pw, ph).alias("size"), F.round(geometry.area_ratio(w, h, pw, ph), 6).alias("area_ratio"), geometry.display_size(w).alias("display_w")
    )


PLACEMENT_SQL = f"""
WITH {BOXES_SQL}
SELECT page_id, ord, {PLACE_SQL} AS placement,
       CASE WHEN w * h / (960.0 * 540) >= 0.35 THEN 'xl' WHEN w * h / (960.0 * 540) >= 0.18 THEN 'lg' WHEN w * h / (960.0 * 540) >= 0.08 THEN 'md' ELSE 'sm' END AS size,
       round(w * h / (960.0 * 540), 6) AS area_ratio, round(w * CAST(0.85 AS DOUBLE), 2) AS display_w
FROM boxes
"""


def box_filter_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers: fitting boxes, one of each place, size and fill, numbered by area."""
    fitting = derived_boxes(spark, sf_dir).where(geometry.fits(F.col("w"), F.col("h"), F.lit(PAGE_W * PAGE_H)))
    return boxes.numbered_boxes(boxes.distinct_boxes(fitting)).select("page_id", "ord", "n", "id")


BOX_FILTER_SQL = f"""
WITH {BOXES_SQL}, f AS (SELECT * FROM boxes WHERE w >= 12 AND h >= 12 AND w * h >= 800 AND w * h <= 0.95 * 960 * 540),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id, round(x, 2), round(y, 2), round(w, 2), round(h, 2), fill ORDER BY ord) = 1)
SELECT page_id, ord, row_number() OVER p - 1 AS n, concat('p', page_id, '_c', row_number() OVER p - 1) AS id
FROM d WINDOW p AS (PARTITION BY page_id ORDER BY w * h, x, y, fill, ord)
"""


def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each box's corner, the smallest other box of the page that holds it."""
    all_boxes = derived_boxes(spark, sf_dir)
    points = all_boxes.select("page_id", F.col("ord").alias("point_id"), F.col("x").alias("left"), F.col("y").alias("top"))
    other = all_boxes.withColumn("id", F.col("ord"))
    # A box holds its own corner, so the point stands a little up and left of it.
    return boxes.smallest_box_at(points.withColumn("left", F.col("left") - 0.5).withColumn("top", F.col("top") - 0.5), other).select("page_id", "point_id", "box_id")


POINT_SQL = f"""
WITH {BOXES_SQL}
SELECT p.page_id, p.ord AS point_id, arg_min(b.ord, struct_pack(a := b.w * b.h, o := b.ord)) FILTER (WHERE b.ord IS NOT NULL) AS box_id
FROM boxes p LEFT JOIN boxes b ON p.page_id = b.page_id AND p.x - 0.5 BETWEEN b.x AND b.x + b.w AND p.y - 0.5 BETWEEN b.y AND b.y + b.h
GROUP BY p.page_id, p.ord
"""


def nearest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each box, moved by up to a point and a half, the nearest box of its page within two points."""
    base = derived_boxes(spark, sf_dir).select("page_id", "ord", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    moved = base.select("page_id", F.col("ord").alias("box_id"), (F.col("x0") + F.col("ord") * 0.5).alias("x0"), "y0", "x1", "y1")
    found = boxes.nearest_entry(moved, base.withColumn("xref", F.col("ord")))
    return found.select("page_id", "box_id", "xref", F.round("distance", 4).alias("distance"))


NEAREST_SQL = f"""
WITH {BOXES_SQL}, b AS (SELECT page_id, ord, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM boxes),
j AS (SELECT m.page_id, m.ord AS box_id, e.ord AS xref, abs(m.x0 + m.ord * 0.5 - e.x0) + abs(m.y0 - e.y0) + abs(m.x1 - e.x1) + abs(m.y1 - e.y1) AS d FROM b m JOIN b e USING (page_id)),
t AS (SELECT page_id, box_id, arg_min(struct_pack(x := xref, d := d), struct_pack(d := d, x := xref)) AS s FROM j GROUP BY page_id, box_id)
SELECT page_id, box_id, CASE WHEN s.d <= 2.0 THEN s.x END AS xref, CASE WHEN s.d <= 2.0 THEN round(s.d, 4) END AS distance FROM t
"""


def palette_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes.palettes(derived_boxes(spark, sf_dir))
    return found.select("page_id", "primary", F.array_join("fills", ",").alias("fills"))


PALETTE_SQL = f"""
WITH {BOXES_SQL}, t AS (SELECT page_id, fill, sum(w * h) AS a, min(ord) AS o FROM boxes WHERE fill <> '' GROUP BY page_id, fill),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(a, 3) DESC, o, fill) AS n FROM t)
SELECT page_id, max(CASE WHEN n = 1 THEN fill END) AS "primary", string_agg(fill, ',' ORDER BY n) AS fills FROM r WHERE n <= 8 GROUP BY page_id
"""


def floating_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the place of their corner, in order."""
    rows = _lines(spark, sf_dir).withColumn("top", F.col("top") % F.lit(PAGE_H))
    rows = rows.withColumn("bucket", geometry.placement_of_corner(F.col("left") * 30 % F.lit(PAGE_W), F.col("top"), F.lit(PAGE_W), F.lit(PAGE_H)))
    listed = F.array_sort(F.collect_list(F.struct("top", "left", "ord")))
    return rows.groupBy("doc_id", "bucket").agg(F.array_join(F.transform(listed, lambda s: s["ord"].cast("string")), ",").alias("line_order"), F.count(F.lit(1)).alias("n"))


FLOATING_SQL = f"""
WITH {LINES_SQL}, p AS (SELECT doc_id, ord, lft, tp % 540 AS t, (lft * 30) % 960 / 960 AS cx, (tp % 540) / 540 AS cy FROM lines)
SELECT doc_id, concat(CASE WHEN cy < 0.38 THEN 'top' WHEN cy > 0.62 THEN 'bottom' ELSE 'middle' END, '_', CASE WHEN cx < 0.38 THEN 'left' WHEN cx > 0.62 THEN 'right' ELSE 'center' END) AS bucket,
       string_agg(CAST(ord AS VARCHAR), ',' ORDER BY t, lft, ord) AS line_order, count(*) AS n
FROM p GROUP BY 1, 2
"""

# ---- Folds


def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of a conversation with the same role class as one."""
    rows = tables.table(spark, sf_dir, "conversations").withColumn("style", F.when(F.col("role") == "user", "user").otherwise("other"))
    merged = blocks.merged_runs(rows, ["conv_id"], "turn", ["style"])
    return merged.select("conv_id", F.col("run").cast("long").alias("run"), "style", F.length("text").cast("long").alias("chars"))


RUN_MERGE_SQL = """
WITH k AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'user' ELSE 'other' END AS style FROM conversations WHERE trim(text) <> ''),
f AS (SELECT *, CASE WHEN style = lag(style) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM k),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM f)
SELECT conv_id, CAST(run AS BIGINT) AS run, style, CAST(sum(length(text)) AS BIGINT) AS chars FROM g GROUP BY conv_id, run, style
"""


def paragraph_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each document's lines."""
    found = blocks.folded_blocks(_lines(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "block", "kind", F.length("text").cast("long").alias("chars"))


#: The order of lines is (top, left, ord): ord * 14 and 9 more for every seventh never swaps lines.
PARAGRAPH_SQL = rf"""
WITH RECURSIVE {LINES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tp, lft, ord) AS i FROM lines),
f AS (
  SELECT doc_id, i, kind, lft AS l0, tp AS t0, lh AS h0, text AS txt, CAST(0 AS BIGINT) AS block FROM n WHERE i = 1
  UNION ALL
  SELECT x.doc_id, x.i, x.kind, CASE WHEN x.go THEN x.l0 ELSE x.lft END, x.tp, CASE WHEN x.go AND x.lh = 0 THEN x.h0 ELSE x.lh END,
         CASE WHEN x.go THEN concat(x.before, CASE WHEN regexp_matches(x.before, '[A-Za-z0-9]\s*$') AND regexp_matches(x.text, '^\s*[A-Za-z0-9]') THEN ' ' ELSE '' END, x.text) ELSE x.text END,
         x.block + CASE WHEN x.go THEN 0 ELSE 1 END
  FROM (
    SELECT n.*, f.l0, f.h0, f.txt AS before, f.block,
           f.kind NOT IN ('title', 'heading') AND f.kind = n.kind AND abs(n.lft - f.l0) <= 3.0 AND NOT (f.h0 <> 0 AND n.tp - f.t0 > f.h0 * 1.9)
             AND NOT regexp_matches(f.txt, '[。！？；:：]\s*$') AS go
    FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1
  ) x
)
SELECT doc_id, block, arg_max(kind, i) AS kind, length({NORMAL_SQL.format(c="arg_max(txt, i)")}) AS chars FROM f GROUP BY doc_id, block
"""


def bullet_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullet lists of each document's lines, every fifth and sixth line a bullet: items and characters of each."""
    rows = _lines(spark, sf_dir).withColumn("kind", F.lit("body"))
    rows = rows.withColumn("text", F.when(F.col("ord") % 5 < 2, F.concat(F.lit("• "), F.col("text"))).otherwise(F.col("text")))
    rows = rows.withColumn("left", F.col("left") + F.when(F.col("ord") % 5 == 2, 20).otherwise(0))
    found = blocks.folded_blocks(rows, ["doc_id"]).where("kind = 'bullets'")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lists"), F.sum(F.size("items")).cast("long").alias("items"), F.sum(F.length(F.array_join("items", ""))).cast("long").alias("chars"))


BULLET_SQL = rf"""
WITH RECURSIVE {LINES_SQL}, n AS (
  SELECT doc_id, text, lft + CASE WHEN ord % 5 = 2 THEN 20 ELSE 0 END AS lft, ord % 5 < 2 AS bullet, row_number() OVER (PARTITION BY doc_id ORDER BY tp, lft + CASE WHEN ord % 5 = 2 THEN 20 ELSE 0 END, ord) AS i FROM lines
), f AS (
  SELECT doc_id, i, bullet AS open, CASE WHEN bullet THEN lft END AS l0, CAST(CASE WHEN bullet THEN 1 ELSE 0 END AS BIGINT) AS list, CAST(CASE WHEN bullet THEN 1 ELSE 0 END AS BIGINT) AS item, CASE WHEN bullet THEN text END AS txt FROM n WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i, n.bullet OR (f.open AND n.lft >= f.l0 + 8),
         CASE WHEN f.open AND (n.bullet OR n.lft >= f.l0 + 8) THEN f.l0 WHEN n.bullet THEN n.lft END,
         f.list + CASE WHEN n.bullet AND NOT f.open THEN 1 ELSE 0 END, f.item + CASE WHEN n.bullet THEN 1 ELSE 0 END,
         CASE WHEN n.bullet THEN n.text WHEN f.open AND n.lft >= f.l0 + 8 THEN concat(f.txt, CASE WHEN regexp_matches(f.txt, '[A-Za-z0-9]\s*$') AND regexp_matches(n.text, '^\s*[A-Za-z0-9]') THEN ' ' ELSE '' END, n.text) END
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1
), t AS (SELECT doc_id, list, item, {NORMAL_SQL.format(c="arg_max(txt, i)")} AS txt FROM f WHERE open GROUP BY doc_id, list, item)
SELECT doc_id, count(DISTINCT list) AS lists, count(*) AS items, CAST(sum(length(txt)) AS BIGINT) AS chars FROM t WHERE txt <> '' GROUP BY doc_id
"""

# ---- Assembly


def frag_union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and first lines of the document of the same number as one numbered list, turns first."""
    turns = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("ord"), "text")
    first = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit(0).cast("long").alias("ord"), F.element_at(F.split("text", "\n"), 1).alias("text"))
    rows = assemble.tagged_union({"group": turns, "floating": first}, "group_type", "rank")
    return assemble.fragment_ids(rows, "page_id", ["rank", "ord"]).select("page_id", "group_type", "ord", "fragment_no", "fragment_id")


FRAG_UNION_SQL = """
WITH u AS (
  SELECT conv_id AS page_id, 'group' AS group_type, 0 AS r, turn AS ord, text FROM conversations
  UNION ALL SELECT doc_id, 'floating', 1, 0, string_split(text, chr(10))[1] FROM documents
), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY r, ord) AS n FROM u WHERE trim(text) <> '')
SELECT page_id, group_type, CAST(ord AS BIGINT) AS ord, n AS fragment_no, concat('t', n) AS fragment_id FROM k
"""


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against labels by language and source: ids without a label, labels without a document, ids labelled twice."""
    docs = tables.table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("page"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"))
    labels = tables.table(spark, sf_dir, "labels").select("doc_id")
    once = labels.select((F.col("doc_id") % 100).alias("page"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"))
    again = labels.where("doc_id % 7 = 0").select((F.col("doc_id") % 100).alias("page"), (F.col("doc_id") + 1_000_000).alias("pos"), F.col("doc_id").alias("id"))
    strange = labels.where("doc_id % 11 = 0").select((F.col("doc_id") % 100).alias("page"), (F.col("doc_id") + 2_000_000).alias("pos"), (-F.col("doc_id") - 1).alias("id"))
    found = validate.id_coverage(docs, once.unionByName(again).unionByName(strange), "page")
    joined = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("missing", "unknown", "duplicate")}
    return found.select("page", *joined.values())


COVERAGE_SQL = """
WITH r AS (SELECT doc_id % 100 AS page, doc_id AS id FROM documents),
u AS (SELECT doc_id % 100 AS page, doc_id AS pos, doc_id AS id FROM labels
      UNION ALL SELECT doc_id % 100, doc_id + 1000000, doc_id FROM labels WHERE doc_id % 7 = 0
      UNION ALL SELECT doc_id % 100, doc_id + 2000000, -doc_id - 1 FROM labels WHERE doc_id % 11 = 0),
k AS (SELECT page FROM r UNION SELECT page FROM u),
m AS (SELECT page, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS s FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.page = r.page AND u.id = r.id) GROUP BY page),
x AS (SELECT page, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS s FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE u.page = r.page AND u.id = r.id) GROUP BY page),
d AS (SELECT page, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS s FROM (SELECT page, id FROM u GROUP BY page, id HAVING count(*) > 1) GROUP BY page)
SELECT k.page, coalesce(m.s, '') AS missing, coalesce(x.s, '') AS "unknown", coalesce(d.s, '') AS duplicate
FROM k LEFT JOIN m USING (page) LEFT JOIN x USING (page) LEFT JOIN d USING (page)
"""


def kind_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of three lines each with the kind and placements of their sources."""
    rows = _lines(spark, sf_dir)
    fragments = rows.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("t"), F.col("ord").cast("string")).alias("fragment_id"), "kind", F.concat(F.lit("place"), (F.length("text") % 3).cast("string")).alias("placement"))
    listed = F.transform(F.array_sort(F.collect_list("ord")), lambda o: F.concat(F.lit("t"), o.cast("string")))
    paragraphs = rows.groupBy(F.col("doc_id").alias("page_id"), F.floor(F.col("ord") / 3).alias("paragraph")).agg(listed.alias("sources"))
    found = assemble.paragraph_hints(paragraphs, fragments)
    return found.select("page_id", "paragraph", "kind_hint", F.array_join("placement_hints", ",").alias("placement_hints"))


KIND_HINT_SQL = f"""
WITH {LINES_SQL}, s AS (
  SELECT doc_id AS page_id, CAST(ord // 3 AS BIGINT) AS paragraph, ord, list_position(['title', 'heading', 'subheading', 'label', 'bullet_item', 'body'], kind) AS r, concat('place', length(text) % 3) AS p FROM lines
), q AS (SELECT page_id, paragraph, p, min(ord) AS o FROM s GROUP BY 1, 2, 3)
SELECT page_id, paragraph, ['title', 'heading', 'subheading', 'label', 'bullet_item', 'body'][min(r)] AS kind_hint,
       (SELECT string_agg(p, ',' ORDER BY o) FROM q WHERE q.page_id = s.page_id AND q.paragraph = s.paragraph) AS placement_hints
FROM s GROUP BY page_id, paragraph
"""


def ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn numbers of a conversation: the user's first from the last on, then the others in order."""
    rows = tables.table(spark, sf_dir, "conversations")
    users = F.reverse(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.col("turn")))))
    merged = rows.groupBy("conv_id").agg(users.alias("a"), F.array_sort(F.collect_list("turn")).alias("b"))
    return merged.select("conv_id", F.array_join(F.transform(assemble.ordered_merge(F.col("a"), F.col("b")), lambda t: t.cast("string")), ",").alias("turns"))


ORDERED_MERGE_SQL = """
SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, CASE WHEN role = 'user' THEN -turn ELSE turn END) AS turns
FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY conv_id
"""


def featured_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived_boxes(spark, sf_dir).withColumn("name", F.concat(F.lit("image"), F.col("ord").cast("string")))
    return assemble.featured(rows)


FEATURED_SQL = f"""
WITH {BOXES_SQL} SELECT page_id, arg_max(concat('image', ord), struct_pack(a := w * h, o := -ord)) AS featured FROM boxes GROUP BY page_id
"""


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and image load of each document, its page number's boxes as images."""
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit("").alias("zh"), F.col("text").alias("en"))
    area = derived_boxes(spark, sf_dir).groupBy("page_id").agg(F.sum(F.col("w") * F.col("h")).alias("image_area"))
    rows = assemble.text_statistics(docs).join(area, "page_id", "left").withColumn("page_area", F.lit(PAGE_W * PAGE_H))
    out = assemble.page_load(rows)
    return out.select("page_id", "en_chars", "paragraphs", "image_ratio", "text_ratio", F.round("effective_lines", 1).alias("lines"), "long_text")


TEXT_STATS_SQL = rf"""
WITH {BOXES_SQL}, a AS (SELECT page_id, sum(w * h) AS image_area FROM boxes GROUP BY page_id),
d AS (SELECT doc_id AS page_id, length(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS en FROM documents),
s AS (SELECT page_id, sum(en) AS en, count(*) AS n FROM d GROUP BY page_id),
j AS (SELECT s.*, least(0.85, greatest(0.0, coalesce(image_area, 0.0) / 518400.0)) AS r FROM s LEFT JOIN a USING (page_id)),
e AS (SELECT *, greatest(CAST(0.35 AS DOUBLE), 1 - CAST(r AS DOUBLE)) AS t, en / 55.0 / greatest(CAST(0.35 AS DOUBLE), 1 - CAST(r AS DOUBLE)) AS l FROM j)
SELECT page_id, CAST(en AS BIGINT) AS en_chars, n AS paragraphs, round(CAST(r AS DOUBLE), 4) AS image_ratio, round(t, 4) AS text_ratio, round(round(l, 2), 1) AS lines, l >= 30 AS long_text FROM e
"""


def priority_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the first text there is: its benchmark item, its page, or a default."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id").distinct()
    first = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("item:"), F.length("text").cast("string")).alias("v"))
    second = tables.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("page:"), F.length("html").cast("string")).alias("v"))
    return assemble.with_first_of(docs, ["doc_id"], [(first, "v"), (second, "v")], F.lit("(missing)"), "found")


PRIORITY_SQL = """
SELECT d.doc_id, coalesce(concat('item:', length(b.text)), concat('page:', length(p.html)), '(missing)') AS found
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id
"""
PRIORITY_SQL = PRIORITY_SQL.replace("concat('item:', length(b.text))", "'item:' || length(b.text)").replace("concat('page:', length(p.html))", "'page:' || length(p.html)")


def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order of a customer, the narrowest of the customer's spans of order keys that holds it."""
    orders = tables.table(spark, sf_dir, "orders")
    points = orders.select("o_custkey", F.col("o_orderkey").alias("point_id"), F.col("o_orderkey").alias("at"))
    ranges = orders.select("o_custkey", (F.col("o_orderkey") - 50 - F.col("o_orderkey") % 977).alias("low"), (F.col("o_orderkey") + 50 + F.col("o_orderkey") % 1013).alias("high"), F.format_string("r%08d", F.col("o_orderkey")).alias("name"))
    return boxes.narrowest_range(points, ranges, "o_custkey").select("o_custkey", "point_id", "name")


INTERVAL_SQL = """
WITH r AS (SELECT o_custkey, o_orderkey - 50 - o_orderkey % 977 AS low, o_orderkey + 50 + o_orderkey % 1013 AS high, format('r{:08d}', o_orderkey) AS name FROM orders)
SELECT p.o_custkey, p.o_orderkey AS point_id, arg_min(r.name, struct_pack(w := high - low, n := r.name)) AS name
FROM orders p JOIN r ON r.o_custkey = p.o_custkey AND p.o_orderkey BETWEEN low AND high GROUP BY p.o_custkey, p.o_orderkey
"""

# ---- Checks


def html_rule_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "pages")
    return rows.select("page_id", F.array_join(validate.markup_warnings(F.col("html")), ",").alias("warnings"))


#: The rules' warnings, for SQL.
RULES_SQL = r"""
  CASE WHEN regexp_matches(html, '(?i)position\s*:\s*absolute') THEN 'forbidden_css: position:absolute' END,
  CASE WHEN regexp_matches(html, '(?i)(^|[^-\w])(top|left)\s*:') THEN 'forbidden_css: top/left' END,
  CASE WHEN regexp_matches(html, '(?i)<style\b') THEN 'forbidden_tag: style' END,
  CASE WHEN regexp_matches(html, '(?i)<link\b[^>]*rel=["'']stylesheet["'']') THEN 'forbidden_tag: link[rel=stylesheet] inside page block' END,
  CASE WHEN regexp_matches(html, '(?i)url\s*\(|background-image\s*:') THEN 'forbidden_css: url()/background-image (use <img> instead)' END,
  CASE WHEN regexp_matches(html, '(?i)overflow(-[xy])?\s*:\s*(auto|scroll)\b') THEN 'forbidden_css: overflow auto/scroll' END"""

HTML_RULES_SQL = f"SELECT page_id, concat_ws(',', {RULES_SQL}) AS warnings FROM pages"


def page_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All warnings of pages that have one reference and need another one, or the same."""
    rows = tables.table(spark, sf_dir, "pages")
    required = F.array(F.concat(F.lit("image"), (F.col("page_id") % 3).cast("string")))
    html = F.concat("html", F.lit('<img data-ref="image1">'))
    return rows.select("page_id", F.array_join(validate.page_warnings(required, html), " | ").alias("warnings"))


PAGE_WARNINGS_SQL = f"""
SELECT page_id, concat_ws(' | ', CASE WHEN page_id % 3 <> 1 THEN concat('missing_data_ref: [''image', page_id % 3, ''']') END,
  CASE WHEN page_id % 3 <> 1 THEN 'unknown_data_ref: [''image1'']' END, {RULES_SQL}) AS warnings
FROM pages
"""


def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.visible_text(tables.table(spark, sf_dir, "pages"), "page_id", "html")
    return rows.where(~text.is_noise(F.col("text"))).groupBy("page_id").agg(F.count(F.lit(1)).alias("fragments"), F.sum(F.length("text")).cast("long").alias("chars"))


#: Texts between tags outside scripts, styles and comments; the four references that the pages have.
VISIBLE_SQL = r"""
WITH c AS (SELECT page_id, regexp_replace(html, '<!--.*?(-->|$)|<script\b.*?(</script\s*>|$)|<style\b.*?(</style\s*>|$)|<noscript\b.*?(</noscript\s*>|$)', '<x>', 'gis') AS h FROM pages),
s AS (SELECT page_id, unnest(regexp_split_to_array(h, '<[^>]*(>|$)')) AS t FROM c),
d AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS t FROM s)
SELECT page_id, count(*) AS fragments, CAST(sum(length(t)) AS BIGINT) AS chars FROM d WHERE t <> '' AND NOT regexp_full_match(t, '[\s\.:。·•●⚫…，,、;；!！?？\-—_]+') GROUP BY page_id
"""


def style_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of pages, in place of styles, numbered by first occurrence."""
    found = tables.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("pos", "style"))
    spans, _ = boxes.style_dictionary(found, F.col("style"), ["pos"])
    return spans.select("doc_id", F.col("pos").cast("long").alias("pos"), "ts")


STYLE_SQL = """
WITH h AS (SELECT page_id AS doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS style FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages)),
f AS (SELECT doc_id, style, min(pos) AS p FROM h WHERE style <> '' GROUP BY doc_id, style),
n AS (SELECT doc_id, style, concat('ts', row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1) AS ts FROM f)
SELECT h.doc_id, CAST(h.pos AS BIGINT) AS pos, n.ts FROM h LEFT JOIN n ON n.doc_id = h.doc_id AND n.style = h.style
"""


def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.content_addressed(tables.table(spark, sf_dir, "documents"), F.col("text"), F.lit(".txt"), ["doc_id"])


CONTENT_SQL = "SELECT concat(substr(sha1(text), 1, 16), '.txt') AS name, count(*) AS copies, min(doc_id) AS doc_id FROM documents GROUP BY 1"


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that contain a benchmark item's text."""
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    items = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return validate.containing(docs, items).select(F.col("text_id").alias("doc_id"), F.col("passage_id").alias("item_id"))


def verbatim_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).distinct()


VERBATIM_SEMI_SQL = "SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


def verbatim_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that no document contains."""
    return tables.table(spark, sf_dir, "benchmark").join(_passages(spark, sf_dir).select("item_id").distinct(), "item_id", "left_anti").select("item_id", F.length("text").cast("long").alias("chars"))


VERBATIM_ANTI_SQL = "SELECT item_id, length(text) AS chars FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))"


def reference_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that notes lack, mention without need, and internal ids in them; the notes are made of order numbers."""
    o = F.col("o_orderkey")
    notes = F.concat(F.lit("see image"), (o % 13).cast("string"), F.lit(" and 第"), (o % 5).cast("string"), F.lit("段 in p3_c"), (o % 3).cast("string"))
    required = F.array(F.concat(F.lit("image"), (o % 7).cast("string")), F.concat(F.lit("第"), (o % 4).cast("string"), F.lit("段")))
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", notes.alias("notes"), required.alias("required"))
    return rows.select(
        "o_orderkey",
        F.array_join(validate.uncovered_references(F.col("required"), F.col("notes")), ",").alias("missing"),
        F.array_join(validate.unknown_references(validate.mentioned(F.col("notes")), F.col("required")), ",").alias("strange"),
        F.array_join(validate.internal_ids(F.col("notes")), ",").alias("internal"),
    )


REFERENCE_SQL = """
WITH r AS (SELECT o_orderkey, o_orderkey % 13 AS a, o_orderkey % 5 AS b, o_orderkey % 3 AS c, o_orderkey % 7 AS ra, o_orderkey % 4 AS rb FROM orders),
s AS (SELECT *, concat('see image', a, ' and 第', b, '段 in p3_c', c) AS notes FROM r)
SELECT o_orderkey,
  concat_ws(',', CASE WHEN NOT contains(notes, concat('image', ra)) THEN concat('image', ra) END, CASE WHEN NOT contains(notes, concat('第', rb, '段')) THEN concat('第', rb, '段') END) AS missing,
  concat_ws(',', CASE WHEN a <> ra THEN concat('image', a) END, CASE WHEN b <> rb THEN concat('第', b, '段') END) AS strange,
  concat('p3_c', c) AS internal
FROM s
"""


def log_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs' states from their log lines: a user is a job, an event a line."""
    return jobs.final_states(jobs.event_lines(tables.table(spark, sf_dir, "events"))).drop("run_dir")


#: A line is a hint, names a result or ends a job; the last exit decides, and without a result a good one is an error.
LOG_SQL = """
WITH l AS (SELECT user_id AS job_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 25 WHEN 'signup' THEN 50 END AS hint,
  CASE event_type WHEN 'view' THEN 'render pages_png' WHEN 'click' THEN 'build plan.json' WHEN 'signup' THEN 'image descriptions' END AS message,
  CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'purchase' AND event_id % 3 > 0 THEN 0 END AS code,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN concat('/out/', event_id, '.pdf') END AS result FROM events),
s AS (SELECT job_id, max(seq) AS last_seq, count(*) AS lines, max(hint) AS hint, arg_max(message, seq) FILTER (WHERE message IS NOT NULL) AS message,
        arg_max(code, seq) FILTER (WHERE code IS NOT NULL) AS code, arg_max(result, seq) FILTER (WHERE result IS NOT NULL) AS result FROM l GROUP BY job_id)
SELECT job_id, CASE WHEN code IS NULL THEN 'running' WHEN code = 0 AND result IS NOT NULL THEN 'done' ELSE 'error' END AS status,
  CAST(CASE WHEN code = 0 AND result IS NULL THEN 99 WHEN code = 0 THEN 100 ELSE greatest(1, coalesce(hint, 1)) END AS BIGINT) AS progress,
  CASE WHEN code = 0 AND result IS NULL THEN 'finished but missing out_repaired.pdf' WHEN code = 0 THEN 'done' WHEN code = 1 THEN 'error' ELSE coalesce(message, 'running') END AS message,
  result AS result_path, lines, last_seq FROM s
"""


def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of pages whose boxes are measured elements: a box must keep within 300 by 200."""
    rows = derived_boxes(spark, sf_dir)
    ref = F.concat(F.lit("e"), F.col("ord").cast("string"))
    measured = rows.select(F.col("page_id").alias("page"), F.lit("element").alias("kind"), F.lit("div").alias("tag"), ref.alias("ref"), F.col("w").cast("long").alias("scroll_w"), F.lit(300).cast("long").alias("client_w"), F.round("h").cast("long").alias("scroll_h"), F.lit(200).cast("long").alias("client_h"), F.col("fill").alias("text"))
    none = spark.createDataFrame([], "page long, extra array<string>")
    found = validate.page_report(measured, none)
    return found.select("page", "ok", F.size("clipped").cast("long").alias("clipped"), "summary")


QA_SQL = f"""
WITH {BOXES_SQL}, m AS (SELECT page_id AS page, concat('e', ord) AS ref, CAST(trunc(w) AS BIGINT) AS sw, CAST(round(h) AS BIGINT) AS sh FROM boxes),
c AS (SELECT page, ref, sh, row_number() OVER (PARTITION BY page ORDER BY sh DESC, ref) AS n FROM m WHERE sw > 301 OR sh > 201),
s AS (SELECT page, count(*) AS clipped, string_agg(concat('p', page, ' clipped: div ref="', ref, '" h ', sh, '/200'), ' | ' ORDER BY n) FILTER (WHERE n <= 3) AS shown FROM c GROUP BY page)
SELECT p.page, s.page IS NULL AS ok, coalesce(s.clipped, 0) AS clipped, coalesce(s.shown, '') AS summary
FROM (SELECT DISTINCT page FROM m) p LEFT JOIN s ON s.page = p.page
"""


def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three lines of each job's log: the limit is the feature."""
    return jobs.tail(jobs.event_lines(tables.table(spark, sf_dir, "events")), 3).select("job_id", "seq", "line")


TAIL_SQL = """
SELECT user_id AS job_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'run render_pages_png.py' WHEN 'click' THEN '$ python /srv/build_plan.py --out x' WHEN 'signup' THEN '$ python /srv/describe_images.py'
    WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN concat('pdf: /out/', event_id, '.pdf') ELSE 'exit: 0' END ELSE 'exit: 1' END AS line
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3
"""


def assembled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one document each, turns in order."""
    rows = tables.table(spark, sf_dir, "conversations").withColumn("part", F.concat("role", F.lit(": "), "text"))
    out = assemble.joined_pages(rows, "conv_id", "turn", "part")
    return out.select("conv_id", F.length("html").cast("long").alias("chars"), F.md5("html").alias("digest"))


ASSEMBLED_SQL = """
SELECT conv_id, length(h) AS chars, md5(h) AS digest FROM (SELECT conv_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS h FROM conversations GROUP BY conv_id)
"""


def condensed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as layout notes, condensed: each fifth line is one of three headings, all others are items."""
    heads = F.array(*map(F.lit, ("Layout contract", "Other", "排版意图（可执行，必须引用 第N段）")))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    notes = F.transform(lines, lambda v, i: F.when(i % 5 == 0, F.get(heads, ((i / 5).cast("long") + F.col("doc_id")).cast("int") % 3)).otherwise(F.concat(F.lit("- "), v)))
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", text.condensed_notes(F.array_join(notes, "\n")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


CONDENSED_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(a))) AS i, unnest(a) AS v FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
h AS (SELECT doc_id, i, CASE WHEN i % 5 = 0 THEN (i // 5 + doc_id) % 3 END AS s, trim('- ' || v) AS item FROM l),
r AS (SELECT doc_id, i, s, last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section,
        CASE s WHEN 0 THEN 'Layout contract' WHEN 1 THEN 'Other' WHEN 2 THEN '排版意图（可执行，必须引用 第N段）' ELSE item END AS t FROM h),
k AS (SELECT *, section = 0 OR (section = 2 AND (s IS NOT NULL OR regexp_matches(t, '\bimage\d+\b|第\d+段|[左右上下]|两栏|两列|分栏|网格|标题|色带')
        OR regexp_matches(t, '(?i)\b(left|right|top|bottom|center|two[- ]column|two[- ]col|column|columns|grid|card|band|title|header|whitespace|align|stack|row)\b')
        OR regexp_matches(t, '(?i)\b(bilingual|english|chinese|80%|50%)\b'))) AS keep FROM r),
n AS (SELECT *, bool_or(keep) OVER (PARTITION BY doc_id) AS hit FROM k),
c AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM n WHERE keep OR NOT hit),
j AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS t FROM c WHERE n <= 60 GROUP BY doc_id)
SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM j
"""


def external_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in place of images embedded in markup, written as files: the file that each part's markup links to."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "png").otherwise("jpeg")
    html = F.concat(F.lit('<img src="data:image/'), kind, F.lit(";base64,"), F.base64(F.encode("p_name", "UTF-8")), F.lit('">'))
    linked, files = tables.external_images(tables.table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")
    linked = linked.withColumn("name", F.regexp_extract("html", 'src="assets/([^"]+)"', 1))
    return linked.join(files, "name").select("p_partkey", "name", F.md5("content").alias("digest"))


EXTERNAL_SQL = """
SELECT p_partkey, concat('embedded_', substr(sha1(p_name), 1, 16), CASE WHEN p_partkey % 2 = 0 THEN '.png' ELSE '.jpg' END) AS name, md5(p_name) AS digest FROM part
"""


def font_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as font names with six ends."""
    end = F.get(F.array(*map(F.lit, ("-Bold", " light", "-Italic", "", " Black", "-BoldItalic"))), F.col("p_partkey").cast("int") % 6)
    rows = tables.table(spark, sf_dir, "part").select("p_partkey", text.font_face(F.concat("p_brand", end)).alias("f"))
    return rows.select("p_partkey", "f.family", F.col("f.weight").cast("long").alias("weight"), "f.style")


FONT_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN concat(p_brand, '-BoldItalic') ELSE p_brand END AS family,
  CAST(CASE p_partkey % 6 WHEN 0 THEN 700 WHEN 1 THEN 300 WHEN 4 THEN 900 ELSE 400 END AS BIGINT) AS weight, CASE WHEN p_partkey % 6 IN (2, 5) THEN 'italic' ELSE 'normal' END AS style
FROM part
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        norm_lines, page_range_scan, block_class, placement_size, box_filter_dedupe, point_in_box, nearest_box, palette_topk, floating_buckets, run_merge, paragraph_fold, bullet_fold,
        frag_union_ids, source_coverage, kind_hint, ordered_merge, featured_argmax, text_stats, priority_coalesce, interval_containment, html_rule_battery, html_visible_text,
        style_dictionary, content_hash_dedupe, verbatim_semi, verbatim_anti, reference_coverage, log_state_machine, qa_report, tail_lines, assembled_pages,
        page_warnings, condensed_notes, external_images, font_faces,
    )
    return {f.__name__: f for f in listed} | paging.queries() | literal.queries()


def oracle_sql() -> dict[str, str]:
    return paging.oracle_sql() | literal.oracle_sql() | {
        "norm_lines": NORM_LINES_SQL,
        "page_range_scan": PAGE_RANGE_SQL,
        "block_class": BLOCK_CLASS_SQL,
        "placement_size": PLACEMENT_SQL,
        "box_filter_dedupe": BOX_FILTER_SQL,
        "point_in_box": POINT_SQL,
        "nearest_box": NEAREST_SQL,
        "palette_topk": PALETTE_SQL,
        "floating_buckets": FLOATING_SQL,
        "run_merge": RUN_MERGE_SQL,
        "paragraph_fold": PARAGRAPH_SQL,
        "bullet_fold": BULLET_SQL,
        "frag_union_ids": FRAG_UNION_SQL,
        "source_coverage": COVERAGE_SQL,
        "kind_hint": KIND_HINT_SQL,
        "ordered_merge": ORDERED_MERGE_SQL,
        "featured_argmax": FEATURED_SQL,
        "text_stats": TEXT_STATS_SQL,
        "priority_coalesce": PRIORITY_SQL,
        "interval_containment": INTERVAL_SQL,
        "html_rule_battery": HTML_RULES_SQL,
        "html_visible_text": VISIBLE_SQL,
        "style_dictionary": STYLE_SQL,
        "content_hash_dedupe": CONTENT_SQL,
        "verbatim_semi": VERBATIM_SEMI_SQL,
        "verbatim_anti": VERBATIM_ANTI_SQL,
        "reference_coverage": REFERENCE_SQL,
        "log_state_machine": LOG_SQL,
        "qa_report": QA_SQL,
        "tail_lines": TAIL_SQL,
        "assembled_pages": ASSEMBLED_SQL,
        "page_warnings": PAGE_WARNINGS_SQL,
        "condensed_notes": CONDENSED_SQL,
        "external_images": EXTERNAL_SQL,
        "font_faces": FONT_SQL,
    }
