"""Box, block, assembly, check, call and stream operators on small tables."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.operators import assemble, blocks, boxes, plan, validate
from leafmill.plans import external, prompts
from leafmill.sources import markup, tables
from leafmill.streaming import jobs

# ---- Boxes


def test_container_boxes(spark):
    schema = "page_id long, ord int, x double, y double, w double, h double, fill string, fill_opacity double, commands array<string>"
    good = (1, 0, 0.0, 0.0, 40.0, 20.0, "#000000", None, ["re"])
    rows = [good]
    for at, value in ((4, 11.99), (5, 19.9), (6, None), (7, 0.0), (8, ["re", "l"]), (8, [])):
        rows.append(tuple(value if i == at else len(rows) if i == 1 else v for i, v in enumerate(good)))
    rows += [(1, 20, 0.0, 0.0, 100.0, 50.1, "#FFF", 1.0, ["re"]), (1, 21, 0.0, 0.0, 100.0, 50.0, "#fff", 1.0, ["re"]), (1, 22, 0.0, 0.0, 100.0, 95.1, "#111111", 1.0, ["re"])]
    kept = boxes.container_boxes(spark.createDataFrame(rows, schema), F.lit(10000.0))
    assert sorted(r.ord for r in kept.collect()) == [0, 21]


def test_boxes_are_deduplicated_and_numbered(spark):
    rows = [(1, 0, 5.0, 0.0, 10.0, 10.0, "a"), (1, 1, 5.001, 0.0, 10.0, 10.0, "a"), (1, 2, 0.0, 0.0, 10.0, 10.0, "b"), (1, 3, 0.0, 0.0, 2.0, 2.0, None), (2, 0, 0.0, 0.0, 1.0, 1.0, "a")]
    df = spark.createDataFrame(rows, "page_id long, ord int, x double, y double, w double, h double, fill string")
    got = {(r.page_id, r.ord): r.id for r in boxes.numbered_boxes(boxes.distinct_boxes(df)).collect()}
    assert got == {(1, 3): "p1_c0", (1, 2): "p1_c1", (1, 0): "p1_c2", (2, 0): "p2_c0"}


def test_opacity_tells_containers_apart(spark):
    rows = [(1, i, 0.0, 0.0, 10.0, 10.0, "a", o) for i, o in enumerate([0.5, 1.0, None, 0.5004, 0.5])]
    df = spark.createDataFrame(rows, "page_id long, ord int, x double, y double, w double, h double, fill string, fill_opacity double")
    assert sorted(r.ord for r in boxes.distinct_boxes(df).collect()) == [0, 1] and [r.ord for r in boxes.distinct_boxes(df, by_fill=False).collect()] == [0]


def test_points_that_are_alike_keep_a_row_each(spark):
    b = spark.createDataFrame([(1, 0, "A", 0.0, 0.0, 10.0, 10.0)], "page_id long, ord int, id string, x double, y double, w double, h double")
    p = spark.createDataFrame([(1, 0, 1.0, 1.0, None)] * 3 + [(1, 0, 1.0, 1.0, "Z"), (1, 0, 99.0, 1.0, None)], "page_id long, point_id int, left double, top double, container string")
    assert sorted(str(r.box_id) for r in boxes.smallest_box_at(p, b).collect()) == ["A", "A", "A", "None", "Z"]
    e = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, 1.0, 1.0)], "page_id long, ord int, xref int, x0 double, y0 double, x1 double, y1 double")
    assert boxes.nearest_entry(e.select("page_id", F.col("ord").alias("box_id"), "x0", "y0", "x1", "y1").unionByName(e.select("page_id", F.col("ord").alias("box_id"), "x0", "y0", "x1", "y1")), e).count() == 2


PLAN = """<div class="page" id="page0"><div class="container-layer"><div class="container" id="c0" data-x="0" data-y="9" data-w="9" data-h="9" data-fill=" #a "></div>
<div class="container"></div><div class="container" id="c1" data-x="bad" data-y="1" data-w="5" data-h="5"></div></div>
<div class="container" id="outside"></div><p style="top:10pt;left:5pt" data-container="c0"><span class="x ts1"><b>Bold</b> line</span>
<p style="top:5pt" data-container="c1">• first</p><p style="top:6pt;left:9pt" data-container="c1"><span>  </span><span> ● </span>second</p><p data-container="none">floats &amp; so</p><p>。。</p></div>"""


def test_planned_pages(spark):
    css = ".ts1{font-size:24pt;color: #1 ;} .ts1{font-size:23pt;}"
    image = '<div class="image-layer"><div class="image" id="i0" data-w="10" data-h="1"></div></div>'
    df = spark.createDataFrame([(1, PLAN, css), (2, None, None), (3, "<p>no page", css)], "k long, h string, c string")
    page = plan.planned_pages(df, "k", "h", "c").first()
    assert plan.planned_pages(df, "k", "h", "c").count() == 1 and page.palette.primary == "#a" and page.images == [] and page.layout_notes == ""
    assert [(g.group_id, [(b.kind, b.text, b["items"]) for b in g.blocks]) for g in page.groups] == [("c1", [("bullets", None, ["first", "second"])]), ("c0", [("subheading", "Bold line", None)])]
    assert [(g.group_id, g.blocks[0].text) for g in page.floating_groups] == [("floating:top_left", "floats & so")]
    bad = spark.createDataFrame([(1, PLAN.replace("</div>", "</div>" + image, 1).replace('<div class="container-layer">', image + '<div class="container-layer">', 1), css)], "k long, h string, c string")
    assert plan.planned_pages(bad, "k", "h", "c", sourceless="skip").first().images == []
    with pytest.raises(Exception, match="i0"):
        plan.planned_pages(bad, "k", "h", "c").collect()
    assert plan.described_pages(plan.planned_pages(df, "k", "h", "c")).count() == 0


def test_page_records_of_odd_pages(spark):
    odd = "<div class=page><p>a<div class=page id=x><p>b <b>c<p>d</b></span><!-- e --></div></div></div><p>f" + "<div class='page'>" * 3
    got = markup.page_records(spark.createDataFrame([(1, odd)], "k long, h string"), "k", "h").collect()
    assert [[["".join(r.text for r in x.runs).strip(), any(r.bold for r in x.runs)] for x in p.lines] for p in got] == [[["a", False]], [["b c", True], ["d", False]], [], [], []]


def test_checked_answers(spark):
    good = '{"zh_paragraphs": ["a"], "en_paragraphs": ["b"], "sources": [["t1"]]}'
    df = spark.createDataFrame([(good,), (good.replace('["b"]', "[]"),)], "a string")
    assert [r[0] for r in df.select(validate.answer_problem(F.col("a"))).collect()] == [None, validate.UNEQUAL]
    assert spark.createDataFrame([(good,)], "a string").select(validate.checked_answer(F.col("a")).alias("x")).first().x.sources == [["t1"]]
    with pytest.raises(Exception, match="length mismatch"):
        df.select(validate.checked_answer(F.col("a")).alias("x")).collect()


def test_files_are_written(spark, tmp_path):
    files = spark.createDataFrame([("a.png", b"one"), ("page1/00.png", b"two"), ("none", None)], "name string, content binary")
    tables.write_files(files, f"file://{tmp_path}/out")
    assert {str(f.relative_to(tmp_path / "out")): f.read_bytes() for f in (tmp_path / "out").rglob("*") if f.is_file()} == {"a.png": b"one", "page1/00.png": b"two", "none": b""}
    tables.write_files(files.withColumn("content", F.encode(F.lit("new"), "UTF-8")), str(tmp_path / "out"), keep=True)
    assert (tmp_path / "out" / "a.png").read_bytes() == b"one"
    with pytest.raises(Exception, match="not below"):
        tables.write_files(spark.createDataFrame([("../x", b"")], "name string, content binary"), str(tmp_path / "out"))


def test_attachments_and_changes(spark):
    asked = spark.createDataFrame([(1, "h", "ask", b"png"), (2, "i", "ask", None)], "page long, request_hash string, request string, picture binary")
    got = external.answers(asked, "page", lambda text, picture: f"{text} {len(picture)}", attachments=["picture"]).collect()
    assert sorted((r.page, r.answer, bool(r.error)) for r in got) == [(1, "ask 3", False), (2, None, True)]
    now, before = (spark.createDataFrame(rows, "page long, html string") for rows in ([(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (2, "x")]))
    assert sorted(r.page for r in external.changed_pages(now, before, "page", "html").collect()) == [2, 3]


def test_clipped_elements(spark):
    schema = "page long, kind string, ref string, scroll_w long, client_w long, scroll_h long, client_h long, text string, overflow_x string, overflow_y string"
    rows = [(1, "element", r, 9, 5, 9, h, "x " * 80, x, y) for r, h, x, y in (("a", 5, "hidden", "visible"), ("b", 5, "visible", "visible"), ("c", 0, "auto", "auto"), ("d", 5, None, None))]
    report = validate.page_report(spark.createDataFrame(rows, schema), spark.createDataFrame([], "page long, extra array<string>")).first()
    assert [c.ref for c in report.clipped] == ["a", "d"] and len(report.clipped[0].text) == 90 and not report.ok


def test_containing_in_blocks(spark):
    texts = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, ""), (1, "a b"), (4, "catcat")], "text_id long, text string")
    passages = spark.createDataFrame([(1, "cat"), (2, "at s"), (3, ""), (4, None), (5, "a"), (6, "cat")], "passage_id long, passage string")
    want = sorted([(1, 1), (1, 2), (1, 5), (1, 6), (1, 5), (4, 1), (4, 5), (4, 6)])
    for most in (1 << 20, 4):
        assert sorted(map(tuple, validate.containing(texts, passages, most).collect())) == want
    assert validate.containing(texts, passages.limit(0)).count() == 0


def test_shadows(spark):
    rows = [(bytes([20, 30, 40] * 20000), 200, 100, 3), (bytes([10, 30, 40] * 20000), 200, 100, 3), (bytes([20, 30, 40] * 100), 10, 10, 3), (None, 200, 100, 3), (bytes([20, 30, 41] * 20000), 200, 100, 3)]
    df = spark.createDataFrame(rows, "p binary, w int, h int, n int")
    size = [F.col(c) for c in "whn"]
    found = df.select(boxes.channel_extremes(F.col("p"), *size).alias("e"), "w", "h").select(boxes.shadow_like(F.col("e"), F.col("w"), F.col("h")))
    assert [r[0] for r in found.collect()] == [True, False, False, False, False]


def test_smallest_box(spark):
    b = spark.createDataFrame([(1, 0, "A", 0.0, 0.0, 10.0, 10.0), (1, 1, "B", 0.0, 0.0, 10.0, 10.0), (1, 2, "C", 5.0, 5.0, 2.0, 2.0), (2, 0, "D", 0.0, 0.0, 99.0, 99.0)], "page_id long, ord int, id string, x double, y double, w double, h double")
    p = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 1, 5.0, 7.0), (1, 2, 10.1, 1.0), (1, 3, None, 1.0), (1, 4, 0.0, 0.0)], "page_id long, point_id int, left double, top double")
    assert {r.point_id: r.box_id for r in boxes.smallest_box_at(p, b).collect()} == {0: "A", 1: "C", 2: None, 3: None, 4: "A"}


def test_nearest_entry(spark):
    e = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, 10.0, 10.0), (1, 1, 8, 0.0, 0.0, 10.0, 10.0), (1, 2, 9, 50.0, 50.0, 60.0, 60.0)], "page_id long, ord int, xref int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([(1, 0, 2.0, 0.0, 10.0, 10.0), (1, 1, 2.0001, 0.0, 10.0, 10.0), (1, 2, 50.0, 50.5, 60.0, 60.5), (2, 3, 0.0, 0.0, 1.0, 1.0)], "page_id long, box_id int, x0 double, y0 double, x1 double, y1 double")
    assert {r.box_id: r.xref for r in boxes.nearest_entry(b, e).collect()} == {0: 7, 1: None, 2: 9, 3: None}


def test_palette_ties_by_first_seen(spark):
    rows = [(1, i, 10.0, 10.0, c) for i, c in enumerate(["#b", "#a", "#a", "#c", None, ""] + [f"#x{k}" for k in range(9)])]
    got = boxes.palettes(spark.createDataFrame(rows, "page_id long, ord int, w double, h double, fill string")).first()
    assert got.primary == "#a" and got.fills[:3] == ["#a", "#b", "#c"] and len(got.fills) == 8


def test_styles_and_contents(spark):
    rows = [(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (1, 3, None), (2, 0, "a")]
    spans, names = boxes.style_dictionary(spark.createDataFrame(rows, "doc_id long, pos int, style string"), F.col("style"), ["pos"])
    assert sorted((r.doc_id, r.pos, r.ts) for r in spans.collect()) == [(1, 0, "ts0"), (1, 1, "ts1"), (1, 2, "ts0"), (1, 3, None), (2, 0, "ts0")]
    assert names.count() == 3
    got = boxes.content_addressed(spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "doc_id long, c string"), F.col("c"), F.lit(".png"), ["doc_id"])
    assert sorted((r.copies, r.doc_id) for r in got.collect()) == [(1, 2), (2, 1)]


# ---- Folds


def model_of_blocks(lines: list[tuple], tolerance: float) -> list[tuple]:
    """Paragraphs and bullets of (text, kind, left, top, lh), written again by hand."""
    out: list[list] = []
    for text, kind, left, top, lh in lines:
        bullet = text[:1] in ("•", "●")
        body = text[1:].strip() if bullet else text
        last = out[-1] if out else None
        if last and last[0] == "bullets" and (bullet or left >= last[2] + 8):
            if bullet:
                last[1].append(body)
            else:
                last[1][-1] += (" " if last[1][-1][-1:].isalnum() and text[:1].isalnum() else "") + text
            continue
        if last and not bullet and last[0] == kind and kind not in ("title", "heading") and abs(left - last[2]) <= tolerance and not (last[4] and top - last[3] > last[4] * 1.9) and last[1][0][-1:] not in "。:":
            last[1][0] += (" " if last[1][0][-1:].isalnum() and text[:1].isalnum() else "") + text
            last[3], last[4] = top, lh or last[4]
            continue
        out.append(["bullets" if bullet else kind, [body], left, top, lh])
    return [(k, tuple(t)) for k, t, *_ in out]


LINE = st.tuples(st.sampled_from(["ab", "c.", "d:", "。", "• x", "● yz", "q"]), st.sampled_from(["body", "body", "title", "label"]), st.sampled_from([0.0, 2.5, 5.0, 8.0, 16.0]), st.sampled_from([10.0, 19.0, 30.0]), st.sampled_from([0.0, 10.0, 12.0]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(LINE, min_size=1, max_size=12), min_size=30, max_size=60))
def test_fold_against_a_model(spark, groups):
    rows, want = [], {}
    for g, lines in enumerate(groups):
        top, placed = 0.0, []
        for i, (text, kind, left, step, lh) in enumerate(lines):
            top += step
            placed.append((text, kind, left, top, lh))
            rows.append((g, i, text, kind, left, top, lh))
        want[g] = model_of_blocks(placed, 3.0)
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, ord int, text string, kind string, left double, top double, lh double")
    got: dict = {g: [] for g in want}
    for r in sorted(blocks.folded_blocks(df, ["g"]).collect(), key=lambda r: (r.g, r.block)):
        got[r.g].append((r.kind, tuple(r["items"]) if r.kind == "bullets" else (r.text,)))
    assert got == want


def test_runs_merge_after_blank_ones_go(spark):
    rows = [(1, 0, "a", True, "r"), (1, 1, " ", False, None), (1, 2, "b", True, "r"), (1, 3, "c", False, None), (1, 4, "d", False, None), (2, 0, "e", False, None)]
    df = spark.createDataFrame(rows, "p long, ord int, text string, bold boolean, color string")
    got = sorted((r.p, r.run, r.text) for r in blocks.merged_runs(df, ["p"], "ord", ["bold", "color"]).collect())
    assert got == [(1, 0, "ab"), (1, 1, "cd"), (2, 0, "e")]


# ---- Assembly and checks


def test_fragments_and_hints(spark):
    schema = "page_id long, groups array<struct<group_id: string, placement: string, blocks: array<struct<kind: string, text: string, items: array<string>>>>>"
    pages = spark.createDataFrame([(1, [("g", "top_left", [("title", "T", None), ("bullets", None, ["x", " ", "y"])])])], schema)
    frags = assemble.fragment_ids(assemble.exploded_blocks(pages), "page_id", ["group_no", "block_no", "item_no"])
    assert [(r.fragment_id, r.kind, r.text) for r in frags.orderBy("fragment_no").collect()] == [("t1", "title", "T"), ("t2", "bullet_item", "x"), ("t3", "bullet_item", "y")]
    paragraphs = spark.createDataFrame([(1, 1, ["t3", "t9", "t1"]), (1, 2, ["t8"]), (1, 3, [])], "page_id long, paragraph int, sources array<string>")
    got = {r.paragraph: (r.kind_hint, r.placement_hints) for r in assemble.paragraph_hints(paragraphs, frags).collect()}
    assert got == {1: ("title", ["top_left"]), 2: ("body", []), 3: ("body", [])}


def test_merge_load_and_replacement(spark):
    df = spark.createDataFrame([(["c", "z", "a"], ["a", "b", "c"]), ([], ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(assemble.ordered_merge(F.col("x"), F.col("y"))).collect()] == [["c", "a", "b"], ["a"]]
    one = spark.createDataFrame([("<a>S old E</a> S other E",)], "h string")
    assert one.select(assemble.with_block_replaced(F.col("h"), "S", "E", F.lit("\\1$2"))).first()[0] == "<a>S\\1$2E</a> S other E"
    with pytest.raises(Exception, match="markers"):
        one.select(assemble.with_block_replaced(F.col("h"), "Q", "E", F.lit("x"))).collect()
    stats = spark.createDataFrame([(1, 280, 550, 90.0, 100.0), (2, 0, 0, None, 0.0)], "page_id long, zh_chars long, en_chars long, image_area double, page_area double")
    got = {r.page_id: (r.image_ratio, r.text_ratio, r.effective_lines, r.long_text) for r in assemble.page_load(stats).collect()}
    assert got == {1: (0.85, 0.35, 57.14, True), 2: (0.0, 1.0, 0.0, False)}


def test_coverage(spark):
    required = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "c")], "page long, ord int, id string")
    used = spark.createDataFrame([(1, 0, "c"), (1, 1, "x"), (1, 2, "c"), (1, 3, "x"), (2, 0, "q")], "page long, pos int, id string")
    got = {r.page: (r.missing, r.unknown, r.duplicate) for r in validate.id_coverage(required, used, "page").collect()}
    assert got == {1: (["b", "a"], ["x", "x"], ["c", "x"]), 2: ([], ["q"], [])}


def test_references_and_markup(spark):
    df = spark.createDataFrame([("see image10 and 第2段 in p1_c4", ["image1", "第1段"])], "n string, r array<string>")
    got = df.select(validate.uncovered_references(F.col("r"), F.col("n")), validate.unknown_references(validate.mentioned(F.col("n")), F.col("r")), validate.internal_ids(F.col("n"))).first()
    assert tuple(got) == (["第1段"], ["image10", "第2段"], ["p1_c4"])
    rows = [("margin-top:3px",), ("top: 1px",), ("overflow-x: scroll",), ('<div data-ref="image1" style="position:absolute">',), ("<style>x</style>",)]
    html = spark.createDataFrame(rows, "h string")
    assert [r[0] for r in html.select(validate.markup_warnings(F.col("h"))).collect()] == [[], ["forbidden_css: top/left"], ["forbidden_css: overflow auto/scroll"], ["forbidden_css: position:absolute"], ["forbidden_tag: style"]]
    assert html.select(validate.uncovered_attributes(F.array(F.lit("image1"), F.lit("image")), F.col("h"))).collect()[3][0] == ["image"]
    arrays = spark.createDataFrame([(["a"], ["b"], [["t1"]]), (["a"], [], [["t1"]]), (None, [], [])], "z array<string>, e array<string>, s array<array<string>>")
    assert [r[0] for r in arrays.select(validate.parallel_arrays(F.col("z"), F.col("e"), F.col("s"))).collect()] == [None, "unequal lengths", "missing array"]


def test_extra_text(spark):
    pools = spark.createDataFrame([(1, "深度学习：\n深度学习 deep learning\nsecond line. Total"), (2, None), (3, "a")], "page_id long, pool string")
    texts = ["deep learning", "DEEP  Learning", "– second line.", "深度学习：deep learning", "深度学习/Total|second line.", "深度学习/wrong", "第", "1.", "！？", "other", "other"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "x y z"), (3, 0, "x y z")], "page_id long, pos int, text string")
    assert {r.page_id: r.extra for r in validate.extra_text(df, pools).collect()} == {1: ["深度学习/wrong", "第", "other"], 3: ["x y z"]}
    texts = [("深度学习：second | Total", None), ("深度学习：second | Total", "："), ("深度学习/second line. Total", "/"), ("深度学习/Total|second line.", "/"), ("深度学习：Total", ""), ("深度学习/Total", None)]
    df = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(texts)], "page_id long, pos int, text string, sign string")
    assert [r.pos for r in validate.unallowed(df, pools).orderBy("pos").collect()] == [1, 3, 4]


def test_page_report(spark):
    schema = "page long, kind string, ref string, tag string, cls string, scroll_w long, client_w long, scroll_h long, client_h long, text string"
    rows = [
        (1, "page", "p", "div", "page", 101, 100, 100, 100, None),
        (1, "element", "e1", "p", " a  b c", 10, 10, 12, 10, "x"),
        (1, "element", None, "h1", None, 10, 10, 30, 10, "x"),
        (1, "element", "e3", "p", None, 10, 10, 30, 10, " "),
        (2, "page", "p", "div", "page", 100, 100, 101, 100, None),
        (3, "page", "p", "div", "page", 130, 100, 102, 100, None),
    ]
    extra = spark.createDataFrame([(3, ["u", "v"])], "page long, extra array<string>")
    got = {r.page: (r.ok, [o.ref for o in r.overflow], [c.tag for c in r.clipped], r.summary) for r in validate.page_report(spark.createDataFrame(rows, schema), extra).collect()}
    assert got == {
        1: (False, [], ["h1", "p"], 'p1 clipped: h1 h 30/10 | p1 clipped: p.a.b ref="e1" h 12/10'),
        2: (True, [], [], ""),
        3: (False, ["p"], [], "p3 overflow: h 102/100, w 130/100 | p3 extra_text: 2"),
    }


def test_warnings(spark):
    many = [f"t{i}" for i in range(21)]
    df = spark.createDataFrame([(["image1", "第1段", "", None], "image1 image2 第9段 floating:body p1_img", '<p data-ref = "image1"> <i data-ref="x">', many), (None, "  ", None, [])], "r array<string>, n string, h string, m array<string>")
    none = F.array().cast("array<string>")
    rows = df.select(validate.notes_warnings(F.col("r"), F.col("n")), validate.page_warnings(F.col("r"), F.col("h")), validate.id_warnings(F.col("m"), none, none)).collect()
    assert rows[0][0] == ["missing_required_refs: ['第1段']", "forbidden_internal_ids: ['floating:body', 'p1_img']", "unknown_image_refs: ['image2']", "unknown_paragraph_refs: ['第9段']"]
    assert rows[0][1] == ["missing_data_ref: ['image1', '第1段']", "unknown_data_ref: ['x']"]
    assert rows[0][2] == ["missing_ids: " + repr(many[:20]) + " ..."]
    assert tuple(rows[1]) == (["layout_notes_missing_or_empty"], [], [])
    listed = df.select(validate.quoted_list(F.array(F.lit("it's"), F.lit('a"b')), 5)).first()[0]
    assert listed == repr(["it's", 'a"b'])
    df = spark.createDataFrame([("see image1", ["image1"]), ("see", ["image1", 'a"b']), ("", ["第1段"])], "n string, r array<string>")
    got = [r[0] for r in df.select(validate.coverage_appendix(F.col("n"), F.col("r"))).collect()]
    assert got == ["see image1", 'see\n\nCoverage checklist (for validation):\n[\n  "image1",\n  "a\\"b"\n]', 'Coverage checklist (for validation):\n[\n  "第1段"\n]']


# ---- Markup


def test_visible_text(spark):
    html = '<div class="page a">one <p>two<script>var t="</p>";</script><div>&copy; three</div><!-- no --><noscript>no</noscript></div>out'
    df = spark.createDataFrame([(1, html), (2, None)], "k long, h string")
    assert [r.text for r in tables.visible_text(df, "k", "h", within="page").orderBy("pos").collect()] == ["one", "two", "© three"]
    assert "out" in [r.text for r in tables.visible_text(df, "k", "h").collect()]


def test_page_markup_and_divs(spark):
    raw = "<!-- PAGE_START -->talk<!-- PAGE_END --> <!-- PAGE_START --><div class='page'>x</div><!-- PAGE_END -->"
    got = tables.page_markup(spark.createDataFrame([(1, raw), (2, "none")], "k long, r string"), "k", "r")
    assert {r.k: r.block for r in got.collect()}[2] is None and "<div class='page'>x</div>" in {r.k: r.block for r in got.collect()}[1]
    html = '<div id="page0"><div>a</div></div><div id="page1">b</div>'
    divs = tables.page_divs(spark.createDataFrame([(1, html)], "k long, h string"), "k", "h")
    assert {r.page: r.div for r in divs.collect()} == {0: '<div id="page0"><div>a</div></div>', 1: '<div id="page1">b</div>'}


def test_styles_and_files(spark, tmp_path):
    css = spark.createDataFrame([(1, "@page { size: 720pt 405.5pt; } .ts0{font-size:12.5pt;color:#fff;} .ts1 {color: red;}"), (2, "")], "doc_id long, css string")
    assert [tuple(r[0]) for r in css.orderBy("doc_id").select(tables.page_size(F.col("css"))).collect()] == [(720.0, 405.5), (959.76, 540.0)]
    assert sorted((r.ts, r.font_size_pt, r.color) for r in tables.text_styles(css).collect()) == [("ts0", 12.5, "#fff"), ("ts1", None, "red")]
    (tmp_path / "chunk_012_012.html").write_text("<p>x</p>")
    assert [(r.page, r.html) for r in tables.chunk_files(spark, str(tmp_path)).collect()] == [(12, "<p>x</p>")]
    (tmp_path / "chunk_001_003.html").write_text("<p>y</p>")
    with pytest.raises(Exception, match="several pages"):
        tables.chunk_files(spark, str(tmp_path)).collect()
    pages = spark.createDataFrame([("f", b"ab")], "path string, content binary")
    assert [tuple(r) for r in tables.rendered_pages(pages, lambda c: [(i, chr(x)) for i, x in enumerate(c)], "page long, png string").collect()] == [("f", 0, "a"), ("f", 1, "b")]


# ---- Calls


def test_retries():
    waits, calls = [], []

    def function(request):
        calls.append(request)
        if len(calls) < 4:
            raise external.CallError(503)
        return "ok"

    assert external.Retries(count=6).call(function, "q", waits.append) == "ok" and waits == [2.0, 4.0, 8.0]
    assert [external.Retries().delay(a) for a in range(7)] == [2, 4, 8, 16, 32, 60, 60]
    with pytest.raises(external.CallError):
        external.Retries().call(lambda _: (_ for _ in ()).throw(external.CallError(400)), "q", waits.append)


def test_repair_loop(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "late"), (3, "never"), (4, "broken")], "page long, what string")
    asked = external.requests(rows, "page", F.struct("what"))

    def function(request: str) -> str:
        if "broken" in request:
            raise ValueError("no")
        return "ok" if "good" in request or ("late" in request and '"round":2' in request) else "bad"

    got = external.repaired(asked, "page", function, F.when(F.col("answer") != "ok", "not ok"), lambda df: df.cache(), rounds=2, retries=external.Retries(count=0))
    assert {r.page: (r.answer, r.problem) for r in got.collect()} == {1: ("ok", None), 2: ("ok", None), 3: ("bad", "not ok"), 4: (None, None)}
    assert {r.page: r.error is None for r in got.collect()}[4] is False
    dry = external.repaired(asked, "page", function, F.lit(None), lambda df: df, dry_run=True)
    assert {r.problem for r in dry.collect()} == {"not asked"}


def test_shrink_scale():
    assert external.shrink_scale(lambda s: True) == 1.0
    assert abs(external.shrink_scale(lambda s: s <= 0.8) - 0.8) < 0.4 / 2**8
    assert external.shrink_scale(lambda s: False) == 0.6
    assert external.shrink_scale(lambda s: False, font=12.0) == pytest.approx(11 / 12)


# ---- Jobs

LINES = [(1, 1, "run render_pages_png.py"), (1, 2, "$ python /x/describe_images.py"), (1, 3, "$ python /x/build_plan.py"), (2, 1, "hello"), (3, 1, "pdf: /out/a.pdf"), (3, 2, "exit: 0"), (4, 1, "$ python /x/qa_repair_export.py"), (4, 2, "exit: 3"), (5, 1, "run_dir: /r"), (5, 2, "exit: 0")]
STATES = {
    1: ("running", 50, "build plan.json", None, None, 3, 3),
    2: ("running", 1, "running", None, None, 1, 1),
    3: ("done", 100, "done", None, "/out/a.pdf", 2, 2),
    4: ("error", 90, "error", None, None, 2, 2),
    5: ("error", 99, "finished but missing out_repaired.pdf", "/r", None, 2, 2),
}


def test_final_states(spark):
    df = spark.createDataFrame(LINES, "job_id long, seq long, line string")
    assert {r.job_id: r[1:] for r in jobs.final_states(df).collect()} == STATES
    every = {r.job_id: r[1:] for r in jobs.final_states(df, spark.range(1, 8).withColumnRenamed("id", "job_id")).collect()}
    assert every == {**STATES, 6: ("queued", 0, "queued", None, None, 0, None), 7: ("queued", 0, "queued", None, None, 0, None)}
    assert [r.seq for r in jobs.tail(df, 2).where("job_id = 1").orderBy("seq").collect()] == [2, 3] and jobs.tail(df, 0).count() == len(LINES)


def test_stream_ends_in_the_batch_states(spark, tmp_path):
    source, out = tmp_path / "in", []
    for i, part in enumerate((LINES[:2], [LINES[3], LINES[5]], [LINES[2], LINES[4], *LINES[6:]])):
        spark.createDataFrame(part, "job_id long, seq long, line string").coalesce(1).write.json(str(source / f"b{i}"))
    lines = spark.readStream.schema("job_id long, seq long, line string").option("maxFilesPerTrigger", 1).json(str(source / "*"))
    query = jobs.state_stream(lines).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend((n, r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.job_id: r[1:] for _, r in sorted(out, key=lambda x: x[0])} == STATES


def test_logs_and_states_are_kept(spark, tmp_path):
    log = str(tmp_path / "log")
    for part in (LINES[:3], LINES[3:]):
        jobs.append_rows(spark.createDataFrame(part, "job_id long, seq long, line string"), log)
    assert spark.read.parquet(log).count() == len(LINES)
    spark.createDataFrame(LINES, "job_id long, seq long, line string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = jobs.line_stream(spark, str(tmp_path / "in"))
    query = jobs.keep_states(jobs.state_stream(stream), str(tmp_path / "states"), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    held = jobs.upsert_latest(spark.read.parquet(str(tmp_path / "states")), ["job_id"], "batch")
    assert {r.job_id: (r.status, r.progress) for r in held.collect()} == {k: v[:2] for k, v in STATES.items()}


def test_settings_and_records(spark, tmp_path):
    spark.conf.set("spark.leafmill.parallel", "5")
    assert tables.setting(spark, "parallel", 3) == 5 and tables.setting(spark, "other", 2.5) == 2.5 and tables.setting(spark, "flag", True) is True
    spark.conf.unset("spark.leafmill.parallel")
    reports = spark.createDataFrame([(2, None, "深"), (1, "x", "a")], "page long, extra string, summary string")
    tables.write_report(reports, str(tmp_path / "r"))
    lines = [x for f in sorted((tmp_path / "r").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ['{"page":1,"extra":"x","summary":"a"}', '{"page":2,"extra":null,"summary":"深"}']
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"page": 1,\n "name": "x"}')
    (tmp_path / "j" / "b.json").write_text("broken {")
    assert sorted(tables.json_records(spark, str(tmp_path / "j"), "page long, name string").collect(), key=str) == [(1, "x"), (None, None)]
    assert reports.select(tables.indented_json(F.struct("page", "summary")).alias("t")).where("t like '{\n%'").count() == 2
    tables.write_pages(spark.createDataFrame([(1, "a"), (2, "b")], "page long, html string"), str(tmp_path / "p"))
    assert (tmp_path / "p" / "page=1").is_dir()
    bad = spark.createDataFrame([("a.pdf", 1), ("b.PDF", 51 << 20), ("c.txt", 1)], "path string, length long")
    assert [r[0] for r in bad.select(tables.upload_status(F.col("path"), F.col("length"))).collect()] == [None, 413, 400]
    with pytest.raises(ValueError):
        tables.page_range(spark.range(1, 6).withColumnRenamed("id", "page"), 2, 9, total=5)


def test_page_chunks(spark):
    whole = '<html><head><title>$1</title></head><body><div id="page0"><div>a</div></div><div id="page999">b\\1</div></body>'
    df = spark.createDataFrame([(1, whole), (2, '<head><BASE href="x"></head><div id="page1">c</div>'), (3, None), (4, '<div id="page0">d</div>')], "k long, h string")
    got = {(r.k, r.page): (r.name, r.html) for r in tables.page_chunks(df, "k", "h").collect()}
    assert set(got) == {(1, 1), (1, 1000), (2, 2), (4, 1)}
    head = '<head>\n<base href="../"><title>$1</title></head>'
    assert got[1, 1] == ("chunk_001_001.html", f'<!doctype html>\n<html lang="zh">\n{head}\n<body>\n<!-- PAGE_START -->\n<div id="page0"><div>a</div></div>\n<!-- PAGE_END -->\n</body>\n</html>')
    assert got[1, 1000][0] == "chunk_1000_1000.html" and 'b\\1</div>' in got[1, 1000][1]
    assert '\n<head><BASE href="x"></head>\n' in got[2, 2][1] and '<head>\n<base href="../"></head>' in got[4, 1][1]
    styled = df.limit(1).select(tables.styled_document(F.lit(" <p>x</p> "), F.lit("t"), "a/b")).first()[0]
    assert styled.splitlines()[3] == '<base href="a/b/">' and styled.endswith("<body>\n<p>x</p>\n</body>\n</html>\n")
    assert [tables.base_href("/a/b", "/a/c"), tables.base_href("/a", "/a"), tables.base_href("/a/b", "/a")] == ["../c", "./", ".."]


def test_external_images(spark):
    import base64
    import hashlib

    data = bytes(range(50))
    code = base64.b64encode(data).decode()
    name = "embedded_" + hashlib.sha1(data).hexdigest()[:16]
    page = f'<img src="data:image/PNG;base64,{code}"><a HREF=\'data:image/jpeg;base64,{code[:30]}\n{code[30:]}\'><img src="data:image/png;base64,abc"><img src="x.png">'
    df = spark.createDataFrame([(1, page), (2, page), (3, None), (4, "")], "k long, h string")
    linked, files = tables.external_images(df, "k", "h")
    want = f'<img src="assets/{name}.png"><a HREF=\'assets/{name}.jpg\'><img src="data:image/png;base64,abc"><img src="x.png">'
    assert [r.h for r in linked.orderBy("k").collect()] == [want, want, None, ""]
    assert sorted((r.name, bytes(r.content)) for r in files.collect()) == [(f"{name}.jpg", data), (f"{name}.png", data)]


def test_ranges_uploads_and_texts(spark, tmp_path):
    pages = spark.range(1, 6).withColumnRenamed("id", "page")
    assert [tables.page_range(pages, *r).count() for r in ((1,), (4, 0), (2, 3), (4, 99), (9, 9))] == [5, 2, 2, 2, 0]
    for bad in ((0,), (3, 2)):
        with pytest.raises(ValueError):
            tables.page_range(pages, *bad)
    files = spark.createDataFrame([("a.PDF", 1), ("b.pdf", 51 << 20), ("c.txt", 1)], "path string, length long")
    assert [r.path for r in tables.uploads(files).collect()] == ["a.PDF"]
    images = spark.createDataFrame([(1, "i0"), (1, "i1"), (2, "i0")], "page_id long, id string")
    described = spark.createDataFrame([(1, 0, "i0", "old"), (1, 1, "i0", " new "), (2, 0, "i0", " ")], "page_id long, pos long, id string, text string")
    got = sorted((r.page_id, r.name, r.content) for r in tables.image_texts(images, described).collect())
    missing = "missing description for this image id\n"
    assert got == [(1, "i0.text.txt", "new\n"), (1, "i1.missing.txt", missing), (2, "i0.missing.txt", missing)]
    for n in (1, 2):
        tables.back_up(spark.range(n), str(tmp_path / "b"), 1)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_prompts(spark):
    import json

    size = "scroll_h long, client_h long, scroll_w long, client_w long"
    schema = f"p struct<page: int, required: array<string>>, a string, r struct<overflow: array<struct<ref: string, {size.replace(' long', ': long')}>>, clipped: array<struct<ref: string, tag: string, cls: string, {size.replace(' long', ': long')}>>, extra: array<string>>"
    clipped = [(f"image{i}", "p", None, 30 - i, 10, 5, 5) for i in range(9)]
    df = spark.createDataFrame([((1, ["第1段"]), "x" * 20000, ([("page", 9, 8, 7, 7)], clipped, [f't"{i}' for i in range(20)])), ((2, []), None, ([], [], []))], schema)
    asked, translated, formatted, noted, repaired = (
        prompts.request(F.col("p")),
        prompts.translation_repair(F.col("p"), F.col("a"), F.lit("missing_ids: ['t1']")),
        prompts.format_repair(prompts.request(F.col("p")), F.col("a")),
        prompts.notes_request(F.col("p"), F.col("p.required")),
        prompts.page_repair(F.col("p"), F.col("a"), F.col("r"), F.lit("notes"), F.lit(".card")),
    )
    one, two = df.select(asked, translated, formatted, noted, repaired).collect()
    assert json.loads(one[0].removeprefix("Input JSON:\n")) == {"page": 1, "required": ["第1段"]}
    assert [one[i].count("x" * n) for i, n in ((1, 6000), (2, 1500), (4, 18000))] == [1, 1, 1] and all("...(truncated)..." in one[i] for i in (1, 2, 4))
    assert "missing_ids: ['t1']" in one[1] and "第1段" in one[3] and "refused answer" not in two[2]
    assert "- Page overflow: h 9/8, w 7/7\n- Clipped text: tag=p data-ref=image0 h 30/10, w 5/5\n" in one[4]
    assert (one[4].count("- Clipped text"), one[4].count("- Text that isn't")) == (6, 12) and "Problems:\nnone\n" in two[4]
