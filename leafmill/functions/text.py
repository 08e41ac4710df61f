"""Text rules as column expressions.

White space, digits and word characters of every script count, so regular expressions are Unicode-aware ((?U)) or name the white space.
A missing match is null, not an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bullet glyphs, and the signs that end a paragraph.
BULLETS = "⚫•●·"
TERMINATORS = "。！？；:："
#: Fixed value: a line of these signs only says nothing.
NOISE = r"(?U)^[\s\.:。·•●⚫…，,、;；!！?？\-—_]+$"
TRIVIAL = r"(?U)^[\s\d\W]+$"
LEADING_BULLETS = r"(?U)^[\s•·●⚫\-–—]+"

#: Font size thresholds of a block's kind, and whether it must be bold.
KIND_SIZES = (("title", 40.0, False), ("heading", 30.0, False), ("subheading", 22.0, True), ("label", 20.0, True))
#: White space of every kind, for a character class and one by one.
WHITE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WHITE_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of it; the property is found faster than a class of ranges.
SPACES = r"(?U)[\s\x1C-\x1F]+"
#: The scripts whose names a log line shows, with the progress and the message that they stand for. The first counts
#: wherever it stands, the others as a path's end.
PROGRESS = (
    ("render_pages_png", 5, "render pages_png"),
    ("extract_ref_html", 15, "extract reference html"),
    ("build_plan", 25, "build plan.json"),
    ("translate_text", 40, "translate text"),
    ("describe_images", 50, "image descriptions"),
    ("generate_layout_notes", 60, "layout notes"),
    ("generate_html", 75, "html generation"),
    ("qa_repair_export", 90, "QA + repair + export"),
)

#: Weights by the last part of a font's name.
FONT_WEIGHTS = (("black", 900), ("extrabold", 800), ("ultrabold", 800), ("bold", 700), ("semibold", 600), ("medium", 500), ("light", 300), ("extralight", 200), ("thin", 100))
#: The sections of layout notes that matter, how those on the layout's intent begin, what a line there must have, and
#: the most lines.
NOTE_SECTIONS = (
    "Content checklist (by reference name)",
    "What the page is conveying (one sentence)",
    "Layout contract",
    "Decorations / parameters",
    "内容清单（按名称/编号）",
    "页面要表达什么（一句话）",
    "排版意图（可执行，必须引用 第N段 / imageN）",
    "排版意图（可执行，必须引用 第N段）",
    "版式契约",
    "装饰与参数",
)
INTENT = "排版意图"
STRUCTURE = (
    r"(?U)\bimage\d+\b|第\d+段|[左右上下]|两栏|两列|分栏|网格|标题|色带"
    r"|(?i)\b(?:left|right|top|bottom|center|two[- ]column|two[- ]col|column|columns|grid|card|band|title|header|whitespace|align|stack|row)\b"
    r"|(?i)\b(?:bilingual|english|chinese|80%|50%)\b"
)
NOTE_LINES = 60
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def present(c: Column) -> Column:
    """The value, or null for an empty string."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE_CHARACTERS))


def normalize(c: Column) -> Column:
    """Runs of white space, no-break ones included, as one space; none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def squeeze(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, SPACES, "")


def says_nothing(normal: Column) -> Column:
    """Whether a normalised text is empty, or of separators and bullet glyphs only."""
    return (normal == "") | normal.rlike(NOISE)


def is_noise(c: Column) -> Column:
    """Empty, or of separators and bullet glyphs only."""
    return says_nothing(normalize(c))


def is_trivial(c: Column) -> Column:
    """Two characters at most, none a letter."""
    return (F.length(c) <= 2) & c.rlike(TRIVIAL)


def has_cjk(c: Column) -> Column:
    return c.rlike("[一-鿿]")


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def is_bullet(c: Column) -> Column:
    """The first visible character is a bullet glyph."""
    return F.coalesce(c, F.lit("")).rlike(rf"(?U)^\s*[{BULLETS}]")


def without_bullet(c: Column) -> Column:
    """Without one leading bullet glyph and the white space around it."""
    return F.regexp_replace(c, rf"(?U)^\s*[{BULLETS}]\s*", "")


def without_leading_bullets(c: Column) -> Column:
    """Without all leading glyphs, dashes and white space."""
    return F.regexp_replace(c, LEADING_BULLETS, "")


def strip_leading_bullet(runs: Column) -> Column:
    """struct(removed, runs): the first run that begins with a bullet glyph loses it; a run that was nothing else goes.

    Runs before it need not be empty, so a later run can be the one."""
    texts = F.transform(runs, lambda r: r["text"])
    at = F.array_position(F.transform(texts, is_bullet), F.lit(True))

    def stripped(r: Column, i: Column) -> Column:
        return F.when(i + 1 == at, r.withField("text", without_bullet(r["text"]))).otherwise(r)

    kept = F.filter(F.transform(runs, stripped), lambda r, i: (i + 1 != at) | (r["text"] != ""))
    return F.struct((at > 0).alias("removed"), F.when(at > 0, kept).otherwise(runs).alias("runs"))


def joined(a: Column, b: Column) -> Column:
    """a and b, with a space between where an ASCII letter or digit would meet another; null as empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    meet = a.rlike(r"(?U)[A-Za-z0-9]\s*$") & b.rlike(r"(?U)^\s*[A-Za-z0-9]")
    return F.concat(a, F.when(meet, F.lit(" ")).otherwise(F.lit("")), b)


def plain_text(runs: Column) -> Column:
    return normalize(F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), ""))


def block_kind(size: Column, bold: Column) -> Column:
    """title, heading, subheading, label or body by the largest font size and whether any run is bold."""
    size, bold = F.coalesce(size, F.lit(0.0)), F.coalesce(bold, F.lit(False))
    out = F.lit("body")
    for kind, least, needs_bold in reversed(KIND_SIZES):
        out = F.when((size >= least) & (bold if needs_bold else F.lit(True)), F.lit(kind)).otherwise(out)
    return out


def block_kind_of_runs(runs: Column) -> Column:
    sizes = F.transform(runs, lambda r: F.coalesce(r["font_size_pt"], F.lit(0.0)))
    return block_kind(F.array_max(sizes), F.exists(runs, lambda r: F.coalesce(r["bold"], F.lit(False))))


def style_pt(style: Column, key: str) -> Column:
    """The points of a style property, or null."""
    return F.expr("double(null)") if not key else present(F.regexp_extract(style, rf"\b{key}\s*:\s*([0-9.]+)pt", 1)).try_cast("double")


def declarations(style: Column) -> Column:
    """A CSS declaration list in one spelling: "key:value;" each, trimmed about the first colon; empty parts go."""
    parts = F.filter(F.transform(F.split(F.coalesce(style, F.lit("")), ";"), strip), lambda p: p != "")

    def spelled(p: Column) -> Column:
        at = F.instr(p, ":")
        return F.when(at > 0, F.concat(strip(F.substring(p, F.lit(1), at - 1)), F.lit(":"), strip(F.substring(p, at + 1, F.length(p))))).otherwise(p)

    out = F.array_join(F.transform(parts, spelled), ";")
    return F.when(out == "", F.lit("")).otherwise(F.concat(out, F.lit(";")))


def without_text_fonts(style: Column) -> Column:
    """A declaration list without font-family, but for symbol fonts, whose glyphs need their font: those are spelled anew. The key
    counts only where the colon follows it at once."""
    parts = F.filter(F.transform(F.split(F.coalesce(style, F.lit("")), ";"), strip), lambda p: p != "")
    key = "font-family:"

    def family(p: Column) -> Column:
        return strip(F.substring(p, F.lit(len(key) + 1), F.length(p)))

    def is_family(p: Column) -> Column:
        return F.startswith(F.lower(p), F.lit(key))

    kept = F.filter(parts, lambda p: ~is_family(p) | F.lower(family(p)).rlike(r"wingdings|zapf|\bsymbol\b"))
    out = F.array_join(F.transform(kept, lambda p: F.when(is_family(p), F.concat(F.lit(key), family(p))).otherwise(p)), ";")
    return F.when(out == "", F.lit("")).otherwise(F.concat(out, F.lit(";")))


def safe_filename(name: Column) -> Column:
    """Letters, digits, dot, plus, dash and underscore; spaces are an underscore each, other runs are one; "file" if nothing is left."""
    spaced = F.replace(strip(F.coalesce(name, F.lit(""))), F.lit(" "), F.lit("_"))
    return F.coalesce(present(F.regexp_replace(spaced, r"[^A-Za-z0-9._+-]+", "_")), F.lit("file"))


def mime_extension(mime: Column) -> Column:
    """The file extension of an image's mime type, with or without "image/" before it."""
    m = F.regexp_replace(F.lower(strip(F.coalesce(mime, F.lit("")))), "^image/", "")
    return F.when(m.isin("jpeg", "jpg"), ".jpg").when(m.isin("png", "webp", "gif"), F.concat(F.lit("."), m)).when(m.isin("svg+xml", "svg"), ".svg").otherwise(".bin")


def font_face(name: Column) -> Column:
    """struct(family, weight, style) that a font's name tells by its last part: "Noto Sans-Bold" is Noto Sans, 700, normal. A name without
    a known end weighs 400; italic or oblique anywhere slants it."""
    end = F.lower(F.regexp_extract(name, r"(?i)[-\s]([a-z]+)$", 1))
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in FONT_WEIGHTS for x in pair)), end), F.lit(400))
    stem = strip(F.regexp_replace(name, r"(?i)[-\s](?:" + "|".join([*(w for w, _ in FONT_WEIGHTS), "italic", "oblique"]) + ")$", ""))
    style = F.when(name.rlike("(?i)italic|oblique"), "italic").otherwise("normal")
    return F.when(name.isNotNull(), F.struct(F.coalesce(present(stem), name).alias("family"), weight.alias("weight"), style.alias("style")))


def choice(value: Column, options: tuple[str, ...], default: str) -> Column:
    """The option that a value names in any case; the default for null or blank; an error for anything else."""
    v = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(v == "", default).when(v.isin(*options), v).otherwise(F.raise_error(F.concat(F.lit("unknown choice: "), v)))


def capped(c: Column, most: int, note: str) -> Column:
    """The trimmed text, or its first ``most`` code points and a note that it was cut. Null as empty."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(note))).otherwise(t)


def condensed_notes(notes: Column) -> Column:
    """The lines of layout notes that direct a page's structure, at most 60; null as empty.

    A line without a leading dash and full-width colon, of at most 60 characters, begins a section. Listed sections stay; of those on
    the layout's intent only lines with a reference or a word on structure or language. Without a listed section: the first 60 lines."""
    lines = F.filter(F.transform(F.split(strip(F.coalesce(notes, F.lit(""))), LINE_ENDS), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("listed"), F.lit(False).alias("intent"))

    def step(state: Column, line: Column) -> Column:
        t = strip(line)
        heading = ~F.startswith(t, F.lit("-")) & ~F.contains(t, F.lit("：")) & (F.length(t) <= 60)
        listed = F.when(heading, t.isin(*NOTE_SECTIONS)).otherwise(state["listed"])
        intent = F.when(heading, F.startswith(t, F.lit(INTENT))).otherwise(state["intent"])
        keep = listed & (heading | ~intent | t.rlike(STRUCTURE))
        return F.struct(F.when(keep, F.concat(state["kept"], F.array(t))).otherwise(state["kept"]).alias("kept"), listed.alias("listed"), intent.alias("intent"))

    kept = F.aggregate(lines, start, step, lambda state: state["kept"])
    return strip(F.array_join(F.slice(F.when(F.size(kept) > 0, kept).otherwise(lines), 1, NOTE_LINES), "\n"))


def unfenced(raw: Column) -> Column:
    """What the first fenced block holds, else the text without stray fences at its ends."""
    text = strip(F.coalesce(raw, F.lit("")))
    inner = F.regexp_extract(text, r"(?is)```(?:[a-z0-9]+)?\s*\n(.*?)```", 1)
    fenced = text.rlike(r"(?is)```(?:[a-z0-9]+)?\s*\n.*?```")
    return F.when(fenced, strip(inner)).otherwise(strip(F.regexp_replace(text, r"(?i)^```(?:[a-z0-9]+)?\s*|\s*```$", "")))


def parsed_object(raw: Column, schema: str) -> Column:
    """The JSON object of a model's answer, or null."""
    return F.from_json(unfenced(raw), schema, {"mode": "PERMISSIVE"})


def objects_of(raw: Column, path: str, schema: str) -> Column:
    """The objects of the array that JSON text holds at a path ("$.pages"), by schema; what isn't an object goes. Null without an array."""
    parts = F.try_variant_get(F.try_parse_json(raw), path, "array<variant>")
    objects = F.filter(parts, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    return F.transform(objects, lambda v: F.from_json(F.to_json(v), schema))


def page_between_markers(html: Column) -> Column:
    """The markup between the first page markers, or null."""
    return present(strip(F.regexp_extract(html, r"(?is)<!--\s*PAGE_START\s*-->(.*?)<!--\s*PAGE_END\s*-->", 1)))


#: Fixed value: a white background in a declaration list.
WHITE_BACKGROUND = r"(?i)\bbackground(?:-color)?\s*:\s*(?:#fff(?:fff)?|rgb\(\s*255\s*,\s*255\s*,\s*255\s*\)|rgba\(\s*255\s*,\s*255\s*,\s*255\s*,\s*1(?:\.0+)?\s*\))\s*;?"


def paper_background(block: Column) -> Column:
    """A literal white background in the style of the first page div becomes the paper variable; the rest of the block stays."""
    tag = F.regexp_extract(block, r"(?is)<div\b[^>]*\bclass\s*=\s*\"[^\"]*\bpage\b[^\"]*\"[^>]*>", 0)
    style = r"(?is)^(.*?\bstyle\s*=\s*\")([^\"]*)(\".*)$"
    parts = [F.regexp_extract(tag, style, i) for i in (1, 2, 3)]
    new = F.concat(parts[0], F.regexp_replace(parts[1], WHITE_BACKGROUND, "background: var(--paper);"), parts[2])
    at = F.instr(block, tag)
    changed = F.concat(F.substring(block, F.lit(1), at - 1), new, F.substring(block, at + F.length(tag), F.length(block)))
    return F.when((tag != "") & tag.rlike(style), changed).otherwise(block)


def numbered(number: Column, width: int = 3) -> Column:
    """With leading zeros up to width; longer numbers stay whole."""
    return F.format_string(f"%0{width}d", number)


def progress_hint(line: Column) -> Column:
    """struct(progress, message) that a log line stands for, or null."""
    out = F.lit(None).cast("struct<progress: int, message: string>")
    for i, (name, percent, message) in reversed(list(enumerate(PROGRESS))):
        shown = F.contains(line, F.lit(f"{name}.py")) if not i else strip(line).rlike(rf"/{name}\.py(?:[{WHITE}]|$)")
        out = F.when(shown, F.struct(F.lit(percent).alias("progress"), F.lit(message).alias("message"))).otherwise(out)
    return out


def keyed_value(line: Column, key: str) -> Column:
    """What stands behind "key:" at the beginning of a line, or null."""
    return F.when(F.startswith(line, F.lit(f"{key}:")), strip(F.substring(line, F.lit(len(key) + 2), F.length(line))))


def decoded_character_references(c: Column) -> Column:
    """Numeric references to characters from U+0080 to U+10FFFF decoded, hexadecimal ones first; all others stay, those of over six
    hexadecimal or seven decimal digits and those of surrogates too.

    References are cut out once each, so every kind of them is replaced by a fold over the text's distinct ones."""

    def character(ref: Column, base: int) -> Column:
        n = F.conv(F.regexp_extract(ref, r"&#x?([0-9a-fA-F]+);", 1), base, 10).try_cast("long")
        ok = (n >= 0x80) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(ref)

    out = c
    for pattern, base in ((r"(&#x[0-9a-fA-F]{1,6};)", 16), (r"(&#[0-9]{1,7};)", 10)):
        found = F.array_distinct(F.regexp_extract_all(out, F.lit(pattern), F.lit(1)))
        out = F.aggregate(found, out, lambda text, ref: F.replace(text, ref, character(ref, base)))
    return out


def safe_relative_path(path: Column) -> Column:
    """Whether a requested path stays below its folder."""
    return ~F.startswith(path, F.lit("/")) & ~F.exists(F.split(path, "/"), lambda p: p == "..")


def iso_time(at: Column) -> Column:
    """A time as ISO 8601 with seconds and the session's offset."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def run_stamp(at: Column) -> Column:
    """A time as part of a folder's name."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def bearer_token(header: Column) -> Column:
    """The token of an authorization header, or null."""
    return present(strip(F.regexp_extract(header, r"(?i)^\s*bearer\s+(.*)$", 1)))
