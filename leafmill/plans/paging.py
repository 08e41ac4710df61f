"""Queries on pages: markup read out of documents, plans, records, boxes of drawings and images, jobs' files; with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import assemble, boxes, plan, validate
from leafmill.plans.derived import BOXES_SQL, LINES_SQL, NORMAL_SQL, PAGE_H, PAGE_W, PLACE_SQL, derived_boxes, derived_lines
from leafmill.sources import tables
from leafmill.streaming import jobs

# ---- Plans of pages that are made of documents' lines

STYLES = ".ts0{font-size:12pt;color:#111111;} .ts1 {font-size:44pt;color:#222222;} .ts2{font-size:24pt;color:#333333;}"
CSS = "@page { size: 960pt 540pt ; } " + STYLES
#: x, y, w, h and fill of each page's containers, the last two the same place as another one's but in another order, and the images.
PLACES = ((20, 300, 400, 200, "#aabbcc"), (20, 40, 900, 100, "#ddeeff"), (500, 300, 300, 200, "#aabbcc"), (700, 20, 100, 60, ""))
IMAGES = ((0, 0, 960, 540), (500, 300, 100, 60), (10, 10, 0, 5))


def _markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, html and css: a page for each document, its lines in three containers and outside, some as bullets, some in two runs."""
    rows = derived_lines(tables.table(spark, sf_dir, "documents"))
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    ts = F.when(F.col("kind") == "title", "ts1").when(F.col("kind") == "subheading", "ts2").otherwise("ts0")
    style = F.format_string("left:%.1fpt;top:%.1fpt;line-height:%.1fpt", "left", "top", "lh")
    container = F.when(F.col("ord") % 4 < 3, F.concat(F.lit(' data-container="c'), (F.col("ord") % 4).cast("string"), F.lit('"'))).otherwise("")
    bullet = F.when(F.col("ord") % 9 == 1, "<span>• </span>").otherwise("")
    body = F.concat(F.lit('<span class="x '), ts, F.lit('"><b>'), escaped, F.lit("</b></span>"))
    line = F.concat(F.lit('<p style="'), style, F.lit('"'), container, F.lit(">"), bullet, body)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("p")))), lambda s: s["p"]), "\n")
    layer = "".join(f'<div class="container" id="c{i}" data-x="{x}" data-y="{y}" data-w="{w}" data-h="{h}" data-fill="{fill}"></div>' for i, (x, y, w, h, fill) in enumerate(PLACES))
    pictures = "".join(f'<div class="image big" id="i{i}" data-src="s{i}.png" data-x="{x}" data-y="{y}" data-w="{w}" data-h="{h}"></div>' for i, (x, y, w, h) in enumerate(IMAGES))
    head = f'<html><body><p>outside</p><div class="page first" id="page0"><div class="container-layer">{layer}</div><div class="image-layer">{pictures}</div>'
    return rows.groupBy("doc_id").agg(F.concat(F.lit(head), listed, F.lit("</div><p>after</p></body></html>")).alias("html")).withColumn("css", F.lit(CSS))


def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each page's plan in order, floating ones behind, with the number and the digest of their blocks."""
    pages = plan.planned_pages(_markup(spark, sf_dir), "doc_id", "html", "css")
    both = F.concat(F.transform("groups", lambda g: F.struct(g["group_id"].alias("id"), g["placement"].alias("placement"), g["blocks"].alias("blocks"))), F.transform("floating_groups", lambda g: F.struct(g["group_id"].alias("id"), g["placement"].alias("placement"), g["blocks"].alias("blocks"))))
    rows = pages.select("doc_id", F.posexplode(both).alias("n", "g"))
    spelled = F.array_join(F.transform("g.blocks", lambda b: F.concat(b["kind"], F.lit(":"), F.coalesce(b["text"], F.array_join(b["items"], "/")))), "|")
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.col("g.id").alias("group_id"), "g.placement", F.size("g.blocks").cast("long").alias("blocks"), F.md5(spelled).alias("digest"))


#: Lines of a group are folded as those of a document are: bullets and paragraphs in one walk.
PAGE_PLAN_SQL = rf"""
WITH RECURSIVE {LINES_SQL}, c AS (
  SELECT * FROM (VALUES {", ".join(f"('c{i}', {x}.0, {y}.0, {w}.0, {h}.0)" for i, (x, y, w, h, _) in enumerate(PLACES))}) AS t(id, x, y, w, h)
), k AS (
  SELECT doc_id, ord, text, lft, tp, lh, CASE WHEN kind = 'title' THEN 'title' WHEN kind = 'subheading' THEN 'subheading' ELSE 'body' END AS kind, ord % 9 = 1 AS bullet,
         CASE WHEN ord % 4 < 3 THEN concat('c', ord % 4) ELSE concat('floating:', CASE WHEN tp / 540 < 0.38 THEN 'top' WHEN tp / 540 > 0.62 THEN 'bottom' ELSE 'middle' END, '_left') END AS g,
         CASE WHEN ord % 4 < 3 THEN 3.0 ELSE 8.0 END AS tol
  FROM lines WHERE NOT regexp_full_match(text, '[\s\.:。·•●⚫…，,、;；!！?？\-—_]+')
), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY tp, lft, ord) AS i FROM k),
f AS (
  SELECT doc_id, g, i, tol, kind, bullet AS list, lft AS l0, tp AS t0, lh AS h0, text AS txt, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS item FROM n WHERE i = 1
  UNION ALL
  SELECT x.doc_id, x.g, x.i, x.tol, CASE WHEN x.list AND x.go THEN x.kind0 ELSE x.kind END, CASE WHEN x.go THEN x.list ELSE x.bullet END,
         CASE WHEN x.go THEN x.l0 ELSE x.lft END, x.tp, CASE WHEN x.go AND x.lh = 0 THEN x.h0 ELSE x.lh END,
         CASE WHEN x.go AND NOT x.bullet THEN concat(x.before, CASE WHEN regexp_matches(x.before, '[A-Za-z0-9]\s*$') AND regexp_matches(x.text, '^\s*[A-Za-z0-9]') THEN ' ' ELSE '' END, x.text) ELSE x.text END,
         x.block + CASE WHEN x.go THEN 0 ELSE 1 END, CASE WHEN x.go THEN x.item + CASE WHEN x.bullet THEN 1 ELSE 0 END ELSE 0 END
  FROM (
    SELECT n.*, f.kind AS kind0, f.list, f.l0, f.h0, f.txt AS before, f.block, f.item,
           CASE WHEN f.list THEN n.bullet OR n.lft >= f.l0 + 8
                ELSE NOT n.bullet AND f.kind NOT IN ('title', 'heading') AND f.kind = n.kind AND abs(n.lft - f.l0) <= f.tol AND NOT (f.h0 <> 0 AND n.tp - f.t0 > f.h0 * 1.9)
                     AND NOT regexp_matches(f.txt, '[。！？；:：]\s*$') END AS go
    FROM f JOIN n ON n.doc_id = f.doc_id AND n.g = f.g AND n.i = f.i + 1
  ) x
), t AS (SELECT doc_id, g, block, item, bool_or(list) AS list, arg_max(kind, i) AS kind, {NORMAL_SQL.format(c="arg_max(txt, i)")} AS txt FROM f GROUP BY doc_id, g, block, item),
b AS (SELECT doc_id, g, block, CASE WHEN bool_or(list) THEN concat('bullets:', string_agg(txt, '/' ORDER BY item)) ELSE concat(max(kind), ':', max(txt)) END AS spelled FROM t GROUP BY doc_id, g, block),
a AS (SELECT doc_id, g, count(*) AS blocks, md5(string_agg(spelled, '|' ORDER BY block)) AS digest FROM b GROUP BY doc_id, g),
p AS (SELECT a.*, c.x, c.y, CASE WHEN c.id IS NULL THEN substr(g, 10) ELSE {PLACE_SQL} END AS placement FROM a LEFT JOIN c ON c.id = a.g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY x IS NULL, y, x, g) - 1 AS n, g AS group_id, placement, blocks, digest FROM p
"""


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette and images of each page's plan, named and ordered for its record, with the references that the page must have."""
    pages = plan.planned_pages(_markup(spark, sf_dir), "doc_id", "html", "css").withColumn("page_id", F.col("doc_id"))
    asked = pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.array(F.lit("s2.png"), F.lit("none.png"), F.lit("s1.png"))).otherwise(F.array().cast("array<string>")).alias("srcs"))
    described = pages.where("page_id % 3 = 0").select("page_id", F.lit("s1.png").alias("src"), F.lit("a text").alias("text"))
    named = plan.named_images(pages.select("page_id", "images"), asked, described)
    paragraphs = F.transform(F.sequence(F.lit(1), (F.col("page_id") % 2 + 1).cast("int")), lambda k: F.struct(F.concat(F.lit("第"), k.cast("string"), F.lit("段")).alias("name")))
    rows = named.join(pages.select("page_id", "palette"), "page_id").withColumn("required", plan.required_references(F.col("images"), paragraphs))

    def spelled(i):
        return F.concat_ws(",", i["name"], i["src"], i["placement"], i["size"], i["display_w_pt"].cast("string"), i["ref_h_pt"].cast("string"), i["description"])

    return rows.select("page_id", "palette.primary", F.array_join("palette.fills", ",").alias("fills"), F.array_join(F.transform("images", spelled), "|").alias("images"), "featured", F.array_join("required.all", ",").alias("required"))


PAGE_IMAGES_SQL = """
SELECT DISTINCT doc_id AS page_id, '#aabbcc' AS "primary", '#aabbcc,#ddeeff' AS fills,
  CASE WHEN doc_id % 2 = 0 THEN concat('image1,s2.png,top_left,sm,|image2,s1.png,middle_center,sm,85.0,60.0,', CASE WHEN doc_id % 3 = 0 THEN 'a text' ELSE '' END, '|image3,s0.png,full,xl,816.0,540.0,')
       ELSE concat('image1,s0.png,full,xl,816.0,540.0,|image2,s1.png,middle_center,sm,85.0,60.0,', CASE WHEN doc_id % 3 = 0 THEN 'a text' ELSE '' END, '|image3,s2.png,top_left,sm,') END AS images,
  CASE WHEN doc_id % 2 = 0 THEN 'image3' ELSE 'image1' END AS featured,
  concat('image1,image2,image3,第1段', CASE WHEN doc_id % 2 = 1 THEN ',第2段' ELSE '' END) AS required
FROM documents WHERE regexp_matches(text, '[^ \\n]')
"""

# ---- Drawings and image blocks


def container_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers among drawings: fills, opacities and commands follow a box's numbers."""
    o = F.col("ord") + F.col("page_id")
    drawn = derived_boxes(spark, sf_dir).withColumn("fill", F.when(o % 5 == 0, F.lit(None)).when(o % 5 == 1, "#FFFFFF").otherwise(F.concat(F.lit("#00000"), (o % 3).cast("string"))))
    drawn = drawn.withColumn("fill_opacity", F.when(o % 7 == 0, 0.0).when(o % 7 == 1, 0.5)).withColumn("commands", F.when(o % 11 == 0, F.array(F.lit("re"), F.lit("l"))).when(o % 11 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("re"))))
    twice = drawn.unionByName(drawn.where("ord % 3 = 0").withColumn("ord", F.col("ord") + 100).withColumn("fill_opacity", F.coalesce("fill_opacity", F.lit(1.0))))
    kept = boxes.container_boxes(twice, F.lit(PAGE_W * PAGE_H))
    return boxes.numbered_boxes(boxes.distinct_boxes(kept)).select("page_id", "ord", "n", "id", F.coalesce("fill_opacity", F.lit(1.0)).alias("fill_opacity"))


CONTAINER_SCAN_SQL = f"""
WITH {BOXES_SQL}, d AS (SELECT page_id, ord, x, y, w, h, CASE (ord + page_id) % 5 WHEN 0 THEN NULL WHEN 1 THEN '#FFFFFF' ELSE concat('#00000', (ord + page_id) % 3) END AS fill,
    CASE (ord + page_id) % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END AS op, (ord + page_id) % 11 > 1 AS rects FROM boxes),
k AS (SELECT * FROM d WHERE fill IS NOT NULL AND op > 0 AND rects AND w >= 12 AND h >= 12 AND w * h >= 800 AND w * h <= 0.95 * 518400 AND NOT (fill = '#FFFFFF' AND w * h > 0.5 * 518400)),
u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page_id, round(x, 2), round(y, 2), round(w, 2), round(h, 2), fill, op ORDER BY ord) = 1)
SELECT page_id, ord, row_number() OVER p - 1 AS n, concat('p', page_id, '_c', row_number() OVER p - 1) AS id, CAST(op AS DOUBLE) AS fill_opacity FROM u WINDOW p AS (PARTITION BY page_id ORDER BY w * h, x, y, fill, ord)
"""


def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images among image blocks, their drawn entries moved by a point or three, some entries masked and dark, whose pixels are known on each fortieth page; and the files that two
    decoders give, of which the first fails on every other image."""
    base = derived_boxes(spark, sf_dir).select("page_id", "ord", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    o = F.col("ord") + F.col("page_id")
    blocks = base.withColumn("image", F.when(o % 13 > 0, F.encode(F.concat(F.lit("i"), o.cast("string")), "UTF-8"))).withColumn("ext", F.lit(" JPG "))
    entries = base.withColumn("x0", F.col("x0") + F.when(o % 4 == 0, 3.0).otherwise(1.0)).withColumn("xref", F.col("ord")).withColumn("has_mask", o % 2 == 0)
    shade = F.when(o % 3 == 0, "10203C").when(o % 3 == 1, "1F2820").otherwise("000000")  # too bright, a shadow, a shadow
    entries = entries.withColumn("width", F.when(o % 5 == 0, 100).otherwise(200)).withColumn("height", F.lit(150)).withColumn("channels", F.lit(3))
    entries = entries.withColumn("pixels", F.when(F.col("page_id") % 40 == 1, F.unhex(F.repeat(shade, F.col("width") * F.col("height")))))
    images = boxes.image_boxes(blocks, entries, F.lit(PAGE_W * PAGE_H))

    def odd(row: dict) -> bytes | None:
        return b"odd" if row["image"][-1] % 2 else None

    def fails(row: dict) -> bytes | None:
        raise ValueError("not this format")

    files = boxes.decoded_images(images.select("page_id", "id", "name", "xref", "image", "ext"), [fails, odd])
    return files.select("page_id", "id", "name", "xref", F.md5("content").alias("digest"))


IMAGE_SCAN_SQL = f"""
WITH {BOXES_SQL}, b AS (SELECT page_id, ord, ord + page_id AS o, x AS x0, y AS y0, x + w AS x1, y + h AS y1, w, h FROM boxes),
e AS (SELECT page_id, ord, o, x0 + CASE WHEN o % 4 = 0 THEN 3.0 ELSE 1.0 END AS x0, y0, x1, y1 FROM b),
k AS (SELECT * FROM b WHERE o % 13 > 0 AND x1 - x0 >= 12 AND y1 - y0 >= 12 AND (x1 - x0) * (y1 - y0) >= 800 AND (x1 - x0) * (y1 - y0) <= 0.95 * 518400
      QUALIFY row_number() OVER (PARTITION BY page_id, round(x0, 2), round(y0, 2), round(x1 - x0, 2), round(y1 - y0, 2) ORDER BY ord) = 1),
j AS (SELECT k.page_id, k.ord, arg_min(struct_pack(x := e.ord, o := e.o, d := abs(k.x0 - e.x0) + abs(k.y0 - e.y0) + abs(k.x1 - e.x1) + abs(k.y1 - e.y1)), struct_pack(d := abs(k.x0 - e.x0) + abs(k.y0 - e.y0) + abs(k.x1 - e.x1) + abs(k.y1 - e.y1), x := e.ord)) AS s, any_value(k.o) AS o
      FROM k JOIN e ON e.page_id = k.page_id GROUP BY k.page_id, k.ord),
m AS (SELECT page_id, ord, o, CASE WHEN s.d <= 2 THEN s.x END AS xref, s.d <= 2 AND s.o % 2 = 0 AND s.o % 3 > 0 AND s.o % 5 > 0 AND page_id % 40 = 1 AS shadow FROM j),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS n FROM m WHERE NOT shadow)
SELECT page_id, concat('p', page_id, '_i', n) AS id, concat(CASE WHEN n < 10 THEN '0' ELSE '' END, n, CASE WHEN o % 2 = 1 THEN '.png' ELSE '.jpg' END) AS name, xref, md5(CASE WHEN o % 2 = 1 THEN 'odd' ELSE concat('i', o) END) AS digest
FROM n
"""

# ---- Allowed text, chunks, markers

SMALL = "abcdefghijklmnopqrstuvwxyz"


def allowed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that a pool doesn't have: the pool is every line but each fifth, and lines are spelled in five ways."""
    rows = derived_lines(tables.table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "page_id")
    o, upper = F.col("ord") % 6, F.translate("text", SMALL, SMALL.upper())
    spelled = F.when(o == 1, F.concat(F.lit("– "), upper)).when(o == 2, F.concat(F.lit("中文："), F.col("text"))).when(o == 3, F.concat(F.lit("中文/"), upper)).when(o == 4, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text"))
    sign = F.when(o == 2, "：").when(o == 3, "/").otherwise("")  # known here; others are the lines' own
    fragments = rows.select("page_id", F.col("ord").alias("pos"), spelled.alias("text"), sign.alias("sign"))
    listed = F.array_sort(F.collect_list(F.when(F.col("ord") % 5 > 0, F.struct("ord", "text"))))
    pools = rows.groupBy("page_id").agg(F.concat(F.lit("中文：\n"), F.array_join(F.transform(listed, lambda s: s["text"]), "\n")).alias("pool"))
    found = validate.extra_text(fragments, pools)
    return found.select("page_id", F.size("extra").cast("long").alias("n"), F.md5(F.array_join("extra", "|")).alias("digest"))


ALLOWED_TEXT_SQL = rf"""
WITH {LINES_SQL}, p AS (SELECT doc_id, '中文：' || chr(10) || coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (WHERE ord % 5 > 0), '') AS pool FROM lines GROUP BY doc_id),
f AS (SELECT doc_id, ord, ord % 6 AS way, text AS line, {NORMAL_SQL.format(c=f'''CASE ord % 6 WHEN 1 THEN '– ' || translate(text, '{SMALL}', '{SMALL.upper()}') WHEN 2 THEN '中文：' || text WHEN 3 THEN '中文/' || translate(text, '{SMALL}', '{SMALL.upper()}') WHEN 4 THEN replace(text, ' ', '  ') ELSE text END''')} AS t FROM lines),
s AS (SELECT f.*, pool, lower(regexp_replace(pool, '[\s\p{{Z}}]+', '', 'g')) AS sq FROM f JOIN p USING (doc_id)),
r AS (SELECT *, {NORMAL_SQL.format(c="line")} AS own FROM s),
bad AS (SELECT doc_id, ord, t FROM r WHERE NOT (
    contains(pool, t) OR contains(sq, lower(regexp_replace(t, '[\s\p{{Z}}]+', '', 'g'))) OR (length(t) <= 2 AND regexp_full_match(t, '[\s\d\W]+'))
    OR (regexp_replace(t, '^[\s•·●⚫\-–—]+', '') <> '' AND contains(sq, lower(regexp_replace(regexp_replace(t, '^[\s•·●⚫\-–—]+', ''), '[\s\p{{Z}}]+', '', 'g'))))
    OR (way IN (2, 3) AND regexp_matches(t, '[A-Za-z]') AND (contains(sq, lower(regexp_replace(own, '[\s\p{{Z}}]+', '', 'g'))) OR (length(own) <= 2 AND regexp_full_match(own, '[\s\d\W]+'))
        OR (regexp_replace(own, '^[\s•·●⚫\-–—]+', '') <> '' AND contains(sq, lower(regexp_replace(regexp_replace(own, '^[\s•·●⚫\-–—]+', ''), '[\s\p{{Z}}]+', '', 'g')))))))),
d AS (SELECT doc_id, t, min(ord) AS o FROM bad GROUP BY doc_id, t),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM d)
SELECT doc_id AS page_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY o)) AS digest FROM c WHERE k <= 40 GROUP BY doc_id
"""


def page_divs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of documents that are made of a conversation's turns, cut out by the depth of their tags."""
    part = F.concat(F.lit('<div id="page'), F.col("turn").cast("string"), F.lit('" class="page"><div>'), F.length("text").cast("string"), F.lit("</div></div>"))
    rows = assemble.joined_pages(tables.table(spark, sf_dir, "conversations").withColumn("part", part), "conv_id", "turn", "part")
    found = tables.page_divs(rows.withColumn("html", F.concat(F.lit("<div><p>"), "html", F.lit("</div>"))), "conv_id", "html")
    return found.select("conv_id", "page", "div")


PAGE_DIVS_SQL = """
SELECT conv_id, turn AS page, concat('<div id="page', turn, '" class="page"><div>', length(text), '</div></div>') AS div FROM conversations
"""


def best_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of answers with two starts and two ends, the stretch that looks most like a page: the longest that holds the page."""
    raw = F.concat(F.lit("so <!-- PAGE_START -->a<!-- PAGE_END --> or <!-- PAGE_START --><div class='page'>"), F.substring("text", 1, 500), F.lit("</div><!-- PAGE_END -->"))
    rows = tables.table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.when(F.col("conv_id") % 4 == 0, "no page").otherwise(raw).alias("raw"))
    return tables.page_markup(rows, "conv_id", "raw").select("conv_id", F.md5("block").alias("digest"))


BEST_MARKUP_SQL = """
SELECT conv_id, CASE WHEN conv_id % 4 > 0 THEN md5(concat('a<!-- PAGE_END --> or <!-- PAGE_START --><div class=''page''>', substr(text, 1, 500), '</div>')) END AS digest FROM conversations WHERE turn = 0
"""


def style_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page size and text styles of sheets, some without a size, a colour or a font size."""
    k = F.col("p_partkey")
    css = F.concat(F.when(k % 3 > 0, F.concat(F.lit("@page { size: "), F.col("p_size").cast("string"), F.lit(".5pt 540pt ; }"))).otherwise(""), F.lit(" .ts1{font-size:"), F.col("p_size").cast("string"), F.lit("pt;}\n.ts2 {color: #"), F.col("p_size").cast("string"), F.lit(" ;x:y} .tsx{color:z;}"))
    rows = tables.table(spark, sf_dir, "part").select(k.alias("doc_id"), css.alias("css"))
    size = rows.select("doc_id", tables.page_size(F.col("css")).alias("s"))
    return tables.text_styles(rows).join(size, "doc_id").select("doc_id", "ts", "font_size_pt", "color", F.col("s.w").alias("w"), F.col("s.h").alias("h"))


STYLE_SHEET_SQL = """
SELECT p_partkey AS doc_id, ts, CASE WHEN ts = 'ts1' THEN CAST(p_size AS DOUBLE) END AS font_size_pt, CASE WHEN ts = 'ts2' THEN concat('#', p_size) END AS color,
       CASE WHEN p_partkey % 3 > 0 THEN p_size + CAST(0.5 AS DOUBLE) ELSE CAST(959.76 AS DOUBLE) END AS w, CAST(540.0 AS DOUBLE) AS h
FROM part, (VALUES ('ts1'), ('ts2')) AS v(ts)
"""


def distinct_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of each brand and of each of three weights that its number stands for."""
    end = F.get(F.array(*map(F.lit, ("-Bold", " bold", "-Thin"))), F.col("p_partkey").cast("int") % 3)
    found = boxes.distinct_faces(tables.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", end).alias("name")), "name", ["p_partkey"])
    return found.select("p_partkey", "family", F.col("weight").cast("long").alias("weight"), "style")


DISTINCT_FONTS_SQL = """
SELECT min(p_partkey) AS p_partkey, p_brand AS family, CAST(CASE WHEN p_partkey % 3 = 2 THEN 100 ELSE 700 END AS BIGINT) AS weight, 'normal' AS style FROM part GROUP BY 2, 3
"""


def container_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of orders as lines of named containers, of which each page has some only: how many are in one and how many float."""
    rows = derived_boxes(spark, sf_dir).select("page_id", F.concat(F.lit("c"), (F.col("ord") % 4).cast("string")).alias("container"))
    known = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("c"), (F.col("o_orderkey") % 4).cast("string")).alias("id"))
    inside, floating = boxes.split_by_container(rows, known)
    both = inside.withColumn("side", F.lit("inside")).unionByName(floating.withColumn("side", F.lit("floating")))
    return both.groupBy("page_id", "side").agg(F.count(F.lit(1)).alias("n"))


CONTAINER_LINES_SQL = f"""
WITH {BOXES_SQL} SELECT page_id, CASE WHEN o_orderkey IS NOT NULL AND ord % 4 = page_id % 4 THEN 'inside' ELSE 'floating' END AS side, count(*) AS n
FROM boxes LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) ON o_orderkey = page_id GROUP BY 1, 2
"""

# ---- Jobs' files, uploads, manifests


def result_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the results of customers' jobs are: orders are files, by kind of priority in one of the job's places or elsewhere."""
    orders = tables.table(spark, sf_dir, "orders")
    job = F.col("o_custkey").cast("string")
    place = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("/run/"), job)).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("/jobs/"), job)).otherwise(F.concat(F.lit("/jobs/"), job, F.lit("/x"), F.col("o_orderkey").cast("string")))
    files = orders.select(F.col("o_custkey").alias("job_id"), F.concat(place, F.lit("/html_outcome/index.html")).alias("path"), F.col("o_orderdate").alias("modificationTime"))
    rows = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))
    key = F.col("job_id").cast("string")
    listed = rows.select("job_id", F.when(F.col("job_id") % 2 == 0, F.concat(F.lit("/run/"), key, F.lit("/"))).alias("run_dir"), F.lit(None).cast("string").alias("result_path"), F.concat(F.lit("/jobs/"), key).alias("job_dir"))
    return jobs.result_folders(listed, files)


RESULT_FOLDERS_SQL = """
WITH f AS (SELECT o_custkey AS j, o_orderkey % 5 AS k, o_orderdate AS t, CASE o_orderkey % 5 WHEN 0 THEN concat('/run/', o_custkey) WHEN 1 THEN concat('/jobs/', o_custkey) ELSE concat('/jobs/', o_custkey, '/x', o_orderkey) END || '/html_outcome' AS p FROM orders),
a AS (SELECT j, bool_or(k = 0) AS run, bool_or(k = 1) AS own, arg_max(p, struct_pack(t := t, p := p)) AS last FROM f GROUP BY j)
SELECT c_custkey AS job_id, CASE WHEN c_custkey % 2 = 0 AND run THEN '/run/' || c_custkey || '/html_outcome' WHEN own THEN '/jobs/' || c_custkey || '/html_outcome' ELSE last END AS folder FROM customer LEFT JOIN a ON j = c_custkey
"""


def current_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user."""
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "event_type")
    return jobs.upsert_latest(rows, ["job_id"], "event_id")


CURRENT_STATES_SQL = "SELECT user_id AS job_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"


def queued_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of customers' jobs; those without events are queued."""
    users = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))
    return jobs.final_states(jobs.event_lines(tables.table(spark, sf_dir, "events")), users).select("job_id", "status", "progress", "lines").where("job_id is not null")


QUEUED_SQL = """
SELECT c_custkey AS job_id, coalesce(s.status, 'queued') AS status, coalesce(s.progress, 0) AS progress, coalesce(s.lines, 0) AS lines
FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN ({log}) s ON s.job_id = c_custkey
"""


def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of the documents that pages are dealt to."""
    rows = tables.table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("document"), F.col("page_id").alias("page"), "url")
    found = plan.manifest(rows, "document")
    return found.select("document", "page_count", F.array_join(F.transform("pages", lambda p: p["url"]), " ").alias("urls"))


MANIFEST_SQL = "SELECT page_id % 7 AS document, count(*) AS page_count, string_agg(url, ' ' ORDER BY page_id) AS urls FROM pages GROUP BY 1"


def notes_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the notes that they have: those of the turns with their number."""
    pages = tables.table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), "url")
    notes = tables.table(spark, sf_dir, "conversations").where("turn = 1").select(F.col("conv_id").alias("page"), F.concat(F.lit(" \n"), "text").alias("notes"))
    first = pages.join(notes, "page").agg(F.min("page")).first()[0]
    return plan.pages_with_notes(pages, notes, first).select("page", "url", F.md5("layout_notes").alias("digest"))


NOTES_SQL = r"SELECT page_id AS page, url, md5(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS digest FROM pages JOIN conversations ON conv_id = page_id AND turn = 1"


QUERIES = (
    page_plan, page_images, container_scan, image_scan, allowed_text, page_divs, best_markup, style_sheet, distinct_fonts, container_lines, result_folders, current_states, queued_states, page_manifest, notes_of_pages,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from leafmill.plans.queries import LOG_SQL

    return {
        "page_plan": PAGE_PLAN_SQL,
        "page_images": PAGE_IMAGES_SQL,
        "container_scan": CONTAINER_SCAN_SQL,
        "image_scan": IMAGE_SCAN_SQL,
        "allowed_text": ALLOWED_TEXT_SQL,
        "page_divs": PAGE_DIVS_SQL,
        "best_markup": BEST_MARKUP_SQL,
        "style_sheet": STYLE_SHEET_SQL,
        "distinct_fonts": DISTINCT_FONTS_SQL,
        "container_lines": CONTAINER_LINES_SQL,
        "result_folders": RESULT_FOLDERS_SQL,
        "current_states": CURRENT_STATES_SQL,
        "queued_states": QUEUED_SQL.format(log=LOG_SQL),
        "page_manifest": MANIFEST_SQL,
        "notes_of_pages": NOTES_SQL,
    }
