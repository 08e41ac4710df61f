"""Queries over literal cases: each row of a table takes a case by its key, and the SQL holds what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import geometry, text
from leafmill.operators import assemble, validate
from leafmill.sources import tables

Case = tuple[object, object]


def _literal(value: object) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _cases(name: str, cases: list[Case], result: Callable[[Column], Column]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """(query, SQL): p_partkey and the result for the case that it takes."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = tables.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(cases)).cast("int").alias("n"))
        given = F.get(F.array(*(F.lit(c) if c is not None else F.lit(None).cast("string") for c, _ in cases)), F.col("n"))
        return rows.withColumn("given", given).select("p_partkey", result(F.col("given")).alias("result"))

    query.__name__ = name
    arms = " ".join(f"WHEN {i} THEN {_literal(want)}" for i, (_, want) in enumerate(cases))
    return query, f"SELECT p_partkey, CASE p_partkey % {len(cases)} {arms} END AS result FROM part"


def _triple(c: Column, i: int) -> Column:
    return F.split(c, " ")[i].try_cast("double")


def _hint(c: Column) -> Column:
    h = text.progress_hint(c)
    return F.concat(h["progress"].cast("string"), F.lit(" "), h["message"])


_START, _END = "<!-- PAGE_START -->", "<!-- PAGE_END -->"


def _appendix(c: Column) -> Column:
    return validate.coverage_appendix(c, F.array(F.lit("image1"), F.lit("第1段")))


_LISTED = 'Coverage checklist (for validation):\n[\n  "image1",\n  "第1段"\n]'

FOUND = {
    name: _cases(name, cases, result)
    for name, cases, result in (
        ("hex_color_cases", [("0 0 0", "#000000"), ("1 1 1", "#ffffff"), ("0.5 0.5 0.5", "#808080"), ("0.1 0.2 0.3", "#1a334c"), ("1.2 -0.1 0", "#ff0000"), ("1 x 0", None)], lambda c: geometry.hex_color(*(_triple(c, i) for i in range(3)))),
        ("style_pt_cases", [("left:12.5pt;top:3pt", 3.0), ("margin-top: 4pt", 4.0), ("top:12px", None), ("", None), (None, None), ("top : 7pt", 7.0)], lambda c: text.style_pt(c, "top")),
        (
            "character_reference_cases",
            [("&#x6df1;", "深"), ("&#28145;", "深"), ("&#x3c;", "&#x3c;"), ("&#x110000;", "&#x110000;"), ("a&#233;b&#x26;&amp;", "aéb&#x26;&amp;"), ("&#xd800;&#127;&#128512;", "&#xd800;&#127;😀")],
            text.decoded_character_references,
        ),
        ("declaration_cases", [(" color : red ;; width:1px", "color:red;width:1px;"), ("", ""), ("a:b:c", "a:b:c;"), ("x", "x;"), (None, ""), (" ; ", "")], text.declarations),
        (
            "text_font_cases",
            [
                ("font-family:Arial;color:red", "color:red;"),
                ("font-family: Wingdings ;a:b", "font-family:Wingdings;a:b;"),
                ("font-family : Arial", "font-family : Arial;"),
                ("FONT-FAMILY:Symbol", "font-family:Symbol;"),
                ("font-family:Symbola", ""),
                ("", ""),
            ],
            text.without_text_fonts,
        ),
        ("file_name_cases", [(" My File(1).PNG ", "My_File_1_.PNG"), ("a+b_c", "a+b_c"), ("___", "___"), ("", "file"), ("深é x", "__x"), (None, "file")], text.safe_filename),
        ("mime_cases", [("image/PNG", ".png"), ("jpg", ".jpg"), ("image/svg+xml", ".svg"), ("image/tiff", ".bin"), (None, ".bin"), ("webp", ".webp")], text.mime_extension),
        (
            "fence_cases",
            [('```json\n{"a": 1}\n```', '{"a": 1}'), ("plain", "plain"), ("", ""), ("before\n```html\n<p>x</p>\n```\nafter", "<p>x</p>"), ("x\n```", "x"), (None, "")],
            text.unfenced,
        ),
        ("object_cases", [('{"a": 7}', 7), ('```json\n{"a": 8}\n```', 8), ("nope", None), ('{"b": 1}', None)], lambda c: text.parsed_object(c, "a long")["a"]),
        (
            "record_cases",
            [('{"pages": [{"id": "a"}, 3, "x", null, {"id": "b", "n": 1}, [1]]}', "a,b"), ('{"pages": []}', ""), ('{"pages": {"id": "a"}}', None), ("[", None)],
            lambda c: F.array_join(F.transform(text.objects_of(c, "$.pages", "id string"), lambda o: o["id"]), ","),
        ),
        ("marker_cases", [(f"x {_START} <div>y</div> {_END} z {_START}2{_END}", "<div>y</div>"), (f"{_START}only", None), ("", None), ("<!--page_start-->a<!-- page_end -->", "a")], text.page_between_markers),
        (
            "background_cases",
            [
                ('<div class="page" style="background:#fff;color:red">x</div>', '<div class="page" style="background: var(--paper);color:red">x</div>'),
                ('<div class="a page b" style="background-color: rgb(255, 255, 255)">x</div>', '<div class="a page b" style="background: var(--paper);">x</div>'),
                ('<div class="page" style="background: rgba(255,255,255,1.0);">x</div>', '<div class="page" style="background: var(--paper);">x</div>'),
                ('<div class="page" style="background:white">x</div>', '<div class="page" style="background:white">x</div>'),
                ('<p class="page" style="background:#fff">x</p>', '<p class="page" style="background:#fff">x</p>'),
                ('<div style="background:#fff"><div class="page" style="color:red">x</div></div>', '<div style="background:#fff"><div class="page" style="color:red">x</div></div>'),
            ],
            text.paper_background,
        ),
        (
            "progress_cases",
            [
                ("$ python /x/build_plan.py --a", "25 build plan.json"),
                ("wrote layout_notes.txt", None),
                ("run render_pages_png.py2", "5 render pages_png"),
                ("python /x/generate_html.pyc", None),
                ("  /x/qa_repair_export.py  ", "90 QA + repair + export"),
                ("generate_layout_notes.py without a path", None),
                ("/a/generate_layout_notes.py x", "60 layout notes"),
            ],
            _hint,
        ),
        ("keyed_value_cases", [("run_dir: /a/b ", "/a/b"), ("run_dir:", ""), (" run_dir: x", None), ("pdf: y", None)], lambda c: text.keyed_value(c, "run_dir")),
        ("appendix_cases", [("has image1", f"has image1\n\n{_LISTED}"), ("image1 and 第1段", "image1 and 第1段"), ("", _LISTED), (None, _LISTED)], _appendix),
        ("path_cases", [("a/b.png", True), ("../a", False), ("/etc", False), ("a/../b", False), ("a..b/c", True)], text.safe_relative_path),
        ("trivial_cases", [("1.", True), ("！？", True), ("第", False), ("a", False), ("1.2", False), ("", False)], text.is_trivial),
        ("noise_cases", [("。。。", True), ("•", True), ("- -", True), ("a.", False), ("　 ", True), (None, True)], text.is_noise),
        (
            "answer_cases",
            [
                ('{"zh_paragraphs": ["a"], "en_paragraphs": ["b"], "sources": [["t1"]]}', None),
                ('{"zh_paragraphs": ["a"], "en_paragraphs": [], "sources": [["t1"]]}', validate.UNEQUAL),
                ('{"zh_paragraphs": "a", "en_paragraphs": ["b"], "sources": [["t1"]]}', validate.NO_ARRAYS),
                ('{"zh_paragraphs": ["a"], "en_paragraphs": ["b"], "sources": ["t1"]}', validate.NO_SOURCE_LISTS),
                ('{"zh_paragraphs": ["a"], "en_paragraphs": ["b"], "sources": [[1]]}', validate.NO_SOURCE_IDS),
                ("no json", validate.NO_ARRAYS),
                ('{"zh_paragraphs": [], "en_paragraphs": [], "sources": []}', None),
            ],
            validate.answer_problem,
        ),
        ("choice_cases", [("Mixed", "mixed"), ("", "single"), (None, "single"), (" SINGLE ", "single")], lambda c: text.choice(c, ("single", "mixed"), "single")),
        ("token_cases", [("Bearer abc ", "abc"), ("bearer  x y", "x y"), ("Basic abc", None), ("", None), (None, None)], text.bearer_token),
        ("capped_cases", [("  abcdef ", "abcd ..."), ("abcd", "abcd"), (None, "")], lambda c: text.capped(c, 4, " ...")),
        ("replaced_block_cases", [(f"a{_START}x{_END}b{_START}y{_END}", f"a{_START}$1\\{_END}b{_START}y{_END}"), (f"{_START}{_END}", f"{_START}$1\\{_END}")], lambda c: assemble.with_block_replaced(c, _START, _END, F.lit("$1\\"))),
        ("upload_cases", [("a.pdf", None), ("A.PDF", None), ("a.png", 400), ("pdf", 400)], lambda c: tables.upload_status(c, F.lit(1))),
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items()}
