"""Column functions at their boundaries."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import geometry, text


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [tuple(r)[0] if len(columns) == 1 else tuple(r) for r in df.select("i", *columns).orderBy("i").drop("i").collect()]


def test_normalize(spark):
    rows = [(" a b\n c ",), ("　x y\t",), (None,), ("",)]
    assert values(spark, rows, "t string", text.normalize(F.col("t"))) == ["a b c", "x y", "", ""]


def test_noise_and_trivial(spark):
    rows = [("。。。",), ("•",), ("- -",), ("a.",), (None,), ("第",)]
    assert values(spark, rows, "t string", text.is_noise(F.col("t"))) == [True, True, True, False, True, False]
    rows = [("1.",), ("！？",), ("第",), ("abc",), ("1 2",)]
    assert values(spark, rows, "t string", text.is_trivial(F.col("t"))) == [True, True, False, False, False]


def test_block_kind(spark):
    rows = [(40.0, False), (39.99, False), (30.0, False), (22.0, True), (22.0, False), (20.0, True), (None, None)]
    got = values(spark, rows, "s double, b boolean", text.block_kind(F.col("s"), F.col("b")))
    assert got == ["title", "heading", "heading", "subheading", "body", "label", "body"]


def test_leading_bullet(spark):
    run = "array<struct<text: string, bold: boolean>>"
    rows = [([("• item", False)],), ([("plain", False), ("● x", True)],), ([("•", False), ("after", False)],), ([("none", False)],)]
    got = values(spark, rows, f"r {run}", text.strip_leading_bullet(F.col("r")))
    assert [(g.removed, [r.text for r in g.runs]) for g in got] == [(True, ["item"]), (True, ["plain", "x"]), (True, ["after"]), (False, ["none"])]


def test_joined(spark):
    rows = [("ab", "cd"), ("ab ", "cd"), ("ab.", "cd"), ("中", "a"), (None, "x"), ("a", None)]
    assert values(spark, rows, "a string, b string", text.joined(F.col("a"), F.col("b"))) == ["ab cd", "ab  cd", "ab.cd", "中a", "x", "a"]


def test_styles(spark):
    rows = [("top:12.5pt;left:3pt",), ("top: x",), (None,)]
    assert values(spark, rows, "s string", text.style_pt(F.col("s"), "top")) == [12.5, None, None]
    rows = [(" color : red ; ;font-family: Arial",), ("",), ("font-family:Wingdings",)]
    assert values(spark, rows, "s string", text.declarations(F.col("s"))) == ["color:red;font-family:Arial;", "", "font-family:Wingdings;"]
    assert values(spark, rows, "s string", text.without_text_fonts(F.col("s"))) == ["color : red;", "", "font-family:Wingdings;"]


def test_names(spark):
    rows = [("a b/c.png",), ("***",), (None,)]
    assert values(spark, rows, "s string", text.safe_filename(F.col("s"))) == ["a_b_c.png", "_", "file"]
    rows = [("image/JPEG ",), ("image/svg+xml",), (None,)]
    assert values(spark, rows, "s string", text.mime_extension(F.col("s"))) == [".jpg", ".svg", ".bin"]
    assert values(spark, [(7,), (1234,)], "n int", text.numbered(F.col("n"))) == ["007", "1234"]
    rows = [("a/b.png",), ("../x",), ("/etc",), ("a/../b",), ("a..b",)]
    assert values(spark, rows, "s string", text.safe_relative_path(F.col("s"))) == [True, False, False, False, True]


def test_answers(spark):
    rows = [("x ```json\n{\"a\": 1}\n``` y",), ("{\"a\": 2}",), ("{\"a\": 3}\n```",), ("",), ("not json",)]
    assert values(spark, rows, "s string", text.unfenced(F.col("s"))) == ['{"a": 1}', '{"a": 2}', '{"a": 3}', "", "not json"]
    got = values(spark, rows, "s string", text.parsed_object(F.col("s"), "a int"))
    assert [g.a if g else None for g in got] == [1, 2, 3, None, None]
    rows = [("<!-- PAGE_START --><div>x</div><!--PAGE_END--> <!--PAGE_END-->",), ("none",)]
    assert values(spark, rows, "s string", text.page_between_markers(F.col("s"))) == ["<div>x</div>", None]
    rows = [('<div class="page" style="background: #FFFFFF"><p style="background:white">$1\\</p></div>',), ("<p>",)]
    assert values(spark, rows, "s string", text.paper_background(F.col("s"))) == ['<div class="page" style="background: var(--paper);"><p style="background:white">$1\\</p></div>', "<p>"]


def test_character_references(spark):
    rows = [("&#x6df1;&#28145; &#x3c;&#60; &#x110000; &#x1F600; &#xD800;",), (None,)]
    assert values(spark, rows, "s string", text.decoded_character_references(F.col("s"))) == ["深深 &#x3c;&#60; &#x110000; 😀 &#xD800;", None]


def test_log_lines(spark):
    rows = [("run /x/build_plan.py now",), ("hello",), ("exit: 0",), ("run_dir: /a: b",)]
    got = values(spark, rows, "s string", text.progress_hint(F.col("s")), text.keyed_value(F.col("s"), "run_dir"))
    assert [(h.progress if h else None, v) for h, v in got] == [(25, None), (None, None), (None, None), (None, "/a: b")]


@pytest.mark.parametrize(
    "box,want",
    [
        ((0, 0, 950, 513), "full"),
        ((0, 0, 900, 189), "band_top"),
        ((0, 351, 900, 100), "band_bottom"),
        ((0, 200, 900, 100), "band_middle"),
        ((0, 0, 900, 190), "top_center"),
        ((380, 205.2, 0, 0), "middle_center"),
        ((620, 334.8, 0, 0), "middle_center"),
        ((379.9, 334.9, 0, 0), "bottom_left"),
        ((700, 100, 100, 100), "top_right"),
    ],
)
def test_placement(spark, box, want):
    columns = [F.col(c) for c in "xywh"]
    got = values(spark, [tuple(map(float, box))], "x double, y double, w double, h double", geometry.placement(*columns, F.lit(1000.0), F.lit(540.0)))
    assert got == [want]


def test_sizes_and_colors(spark):
    rows = [(35.0, 1.0), (34.9, 1.0), (18.0, 1.0), (8.0, 1.0), (7.9, 1.0)]
    assert values(spark, rows, "w double, h double", geometry.size_bucket(F.col("w"), F.col("h"), F.lit(10.0), F.lit(10.0))) == ["xl", "lg", "lg", "md", "sm"]
    assert values(spark, [(1.0, 1.0)], "w double, h double", geometry.area_ratio(F.col("w"), F.col("h"), F.lit(0.0), F.lit(5.0))) == [None]
    rows = [(1.0, 0.5, 0.0), (2.0, -1.0, 0.1), (None, 0.0, 0.0)]
    assert values(spark, rows, "r double, g double, b double", geometry.hex_color(F.col("r"), F.col("g"), F.col("b"))) == ["#ff8000", "#ff001a", None]
    assert values(spark, [(0.0, 0.0)], "x double, y double", geometry.placement_of_corner(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0))) == ["middle_center"]


def test_font_face(spark):
    rows = [("Noto Sans-Bold",), ("X ExtraLight",), ("Y-BoldItalic",), ("Z-Oblique",), ("-Black",), ("Plain",), ("Semibold",), (None,)]
    got = values(spark, rows, "s string", text.font_face(F.col("s")))
    assert [tuple(g) if g else None for g in got] == [("Noto Sans", 700, "normal"), ("X", 200, "normal"), ("Y-BoldItalic", 400, "italic"), ("Z", 400, "italic"), ("-Black", 900, "normal"), ("Plain", 400, "normal"), ("Semibold", 400, "normal"), None]


def test_choice_and_caps(spark):
    assert values(spark, [(" Mixed ",), ("",), (None,)], "s string", text.choice(F.col("s"), ("single", "mixed"), "single")) == ["mixed", "single", "single"]
    with pytest.raises(Exception, match="unknown choice"):
        values(spark, [("other",)], "s string", text.choice(F.col("s"), ("single", "mixed"), "single"))
    assert values(spark, [(" abcd ",), ("abc",), (None,)], "s string", text.capped(F.col("s"), 3, "…cut")) == ["abc…cut", "abc", ""]


def test_condensed_notes(spark):
    listed = "Layout contract\n- a\n\n  - b  \nOther\n- c\nDecorations / parameters\r\n- d：e"
    intent = "排版意图（可执行，必须引用 第N段）\n- put image1 there\n- nothing\n- 第2段 first\n- BILINGUAL text\n- left\n- upright\n- 标题"
    plain = "\n".join(f"- line {i}" for i in range(70))
    long = "Layout contract\n" + "\n".join(f"- {i}" for i in range(70))
    got = values(spark, [(listed,), (intent,), (plain,), (long,), (" \n ",), (None,)], "s string", text.condensed_notes(F.col("s")))
    assert got[0] == "Layout contract\n- a\n- b\nDecorations / parameters\n- d：e"
    assert got[1] == "排版意图（可执行，必须引用 第N段）\n- put image1 there\n- 第2段 first\n- BILINGUAL text\n- left\n- 标题"
    assert got[2].split("\n") == [f"- line {i}" for i in range(60)]
    assert got[3].split("\n") == ["Layout contract", *(f"- {i}" for i in range(59))]
    assert got[4:] == ["", ""]


def test_times(spark):
    rows = [("2024-03-05 06:07:08",)]
    at = F.col("s").cast("timestamp")
    assert spark.createDataFrame(rows, "s string").select(text.iso_time(at), text.run_stamp(at)).first()[:] == ("2024-03-05T06:07:08Z", "20240305_060708")
