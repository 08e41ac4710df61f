"""Checks of generated output: coverage of ids and references, markup rules, verbatim text, measured overflow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.sources.shipping import ship

#: Markup that a page must not have, by its warning.
MARKUP_RULES = (
    ("forbidden_css: position:absolute", r"(?i)position\s*:\s*absolute"),
    ("forbidden_css: top/left", r"(?i)(?<![-\w])(?:top|left)\s*:"),
    ("forbidden_tag: style", r"(?i)<style\b"),
    ("forbidden_tag: link[rel=stylesheet] inside page block", r"(?i)<link\b[^>]*rel=[\"']stylesheet[\"']"),
    ("forbidden_css: url()/background-image (use <img> instead)", r"(?i)url\s*\(|background-image\s*:"),
    ("forbidden_css: overflow auto/scroll", r"(?i)overflow(?:-[xy])?\s*:\s*(?:auto|scroll)\b"),
)
#: How references are spelled, and internal ids that must not be seen.
IMAGE_REFERENCE, PARAGRAPH_REFERENCE = r"(?U)\bimage\d+\b", r"(?U)第\d+段"
REFERENCE = r"(?U)\bimage\d+\b|第\d+段"
INTERNAL_ID = r"(?U)\b(?:p\d+_[A-Za-z_]+\d*|floating:[A-Za-z_]+)\b"
#: Items in a warning of ids and of references, and what stands before a checklist.
ID_ITEMS, REFERENCE_ITEMS = 20, 30
CHECKLIST = "Coverage checklist (for validation):\n"
#: Fixed value: signs between the two languages of a bilingual text.
SEPARATORS = "：:/／|｜"
#: Pixels by which content may exceed its box, offending texts in a report, clipped texts in a summary, and characters of
#: such a text that are shown.
TOLERANCE, MOST_TEXTS, SUMMARY_ITEMS, SAMPLE = 1, 40, 3, 90


def id_coverage(required: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """key, missing, unknown, duplicate: of ids per key, those not used (in order of ord), those used and not required (in order of
    pos, repeats kept), and those used more than once (sorted). required: key, ord, id; used: key, pos, id."""
    missing = required.join(used, [key, "id"], "left_anti").groupBy(key).agg(_listed("ord").alias("missing"))
    unknown = used.join(required, [key, "id"], "left_anti").groupBy(key).agg(_listed("pos").alias("unknown"))
    often = used.groupBy(key, "id").count().where("count > 1").groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("duplicate"))
    keys = required.select(key).unionByName(used.select(key)).distinct()
    out = keys.join(missing, key, "left").join(unknown, key, "left").join(often, key, "left")
    return out.select(key, *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in out.select("missing", "unknown", "duplicate").dtypes))


def _listed(order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, "id"))), lambda s: s["id"])


def parallel_arrays(zh: Column, en: Column, sources: Column) -> Column:
    """null if the three arrays are there and equally long, else what is wrong."""
    return F.when(zh.isNull() | en.isNull() | sources.isNull(), "missing array").when((F.size(zh) != F.size(en)) | (F.size(zh) != F.size(sources)), "unequal lengths")


#: The arrays of a translation's answer, and what is said where they aren't there or don't fit together.
ANSWER_ARRAYS = ("zh_paragraphs", "en_paragraphs", "sources")
NO_ARRAYS = "output JSON must contain arrays: zh_paragraphs, en_paragraphs, sources"
UNEQUAL = "length mismatch: zh_paragraphs, en_paragraphs, sources must have same length"
NO_SOURCE_LISTS, NO_SOURCE_IDS = "sources must be an array of arrays", "sources entries must be strings (text ids)"


def answer_problem(answer: Column) -> Column:
    """What is wrong with a translation's answer (JSON text), or null: three arrays of one length, the last of arrays of strings."""
    value = F.try_parse_json(answer)
    parts = [F.try_variant_get(value, f"$.{name}", "array<variant>") for name in ANSWER_ARRAYS]
    arrays = [F.startswith(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")), F.lit("ARRAY")) for name in ANSWER_ARRAYS]
    kinds = F.transform(parts[2], lambda v: F.schema_of_variant(v))
    entries = F.flatten(F.transform(parts[2], lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))))
    strings = F.forall(entries, lambda v: F.schema_of_variant(v) == "STRING")
    there = F.coalesce(arrays[0] & arrays[1] & arrays[2], F.lit(False))
    equal = (F.size(parts[0]) == F.size(parts[1])) & (F.size(parts[0]) == F.size(parts[2]))
    lists = F.forall(kinds, lambda k: F.startswith(k, F.lit("ARRAY")))
    return F.when(~there, NO_ARRAYS).when(~equal, UNEQUAL).when(~lists, NO_SOURCE_LISTS).when(~strings, NO_SOURCE_IDS)


def checked_answer(answer: Column) -> Column:
    """struct(zh_paragraphs, en_paragraphs, sources) of a translation's answer; an error where ``answer_problem`` finds one."""
    problem = answer_problem(answer)
    parsed = F.from_json(answer, "zh_paragraphs array<string>, en_paragraphs array<string>, sources array<array<string>>")
    return F.when(problem.isNull(), parsed).otherwise(F.raise_error(problem))


def uncovered_references(required: Column, notes: Column) -> Column:
    """The references that the notes don't contain. As plain containment is asked for, image1 is covered by image10."""
    return F.filter(required, lambda r: ~F.contains(notes, r))


def uncovered_attributes(required: Column, html: Column) -> Column:
    """The references without a data-ref attribute, in double quotes."""
    return F.filter(required, lambda r: ~F.contains(html, F.concat(F.lit('data-ref="'), r, F.lit('"'))))


def unknown_references(found: Column, required: Column) -> Column:
    return F.array_sort(F.array_except(F.array_distinct(found), required))


def mentioned(notes: Column) -> Column:
    """The references that notes mention."""
    return F.regexp_extract_all(notes, F.lit(f"({REFERENCE})"), F.lit(1))


def attribute_values(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'data-ref\s*=\s*"([^"]+)"'), F.lit(1))


def internal_ids(text_: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text_, F.lit(f"({INTERNAL_ID})"), F.lit(1))))


def markup_warnings(html: Column) -> Column:
    """The warnings of the rules that the markup breaks, in order."""
    return F.array_compact(F.array(*(F.when(html.rlike(pattern), F.lit(name)) for name, pattern in MARKUP_RULES)))


def quoted_list(items: Column, most: int) -> Column:
    """A list as text, quoted, with " ..." behind it if it has more than ``most`` items."""
    quoted = F.transform(F.slice(items, 1, most), lambda x: F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"), F.when(F.size(items) > most, " ...").otherwise(""))


def _warning(name: str, items: Column, most: int) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{name}: "), quoted_list(items, most)))


def id_warnings(missing: Column, duplicate: Column, unknown: Column) -> Column:
    """The warnings of an answer's ids, as ``id_coverage`` finds them."""
    named = (("missing_ids", missing), ("duplicate_ids", duplicate), ("unknown_ids", unknown))
    return F.array_compact(F.array(*(_warning(name, items, ID_ITEMS) for name, items in named)))


def page_warnings(required: Column, html: Column) -> Column:
    """The warnings of a page's markup: references without or beyond those required, internal ids, forbidden markup. Null as empty."""
    html, required = F.coalesce(html, F.lit("")), _references(required)
    found = (
        _warning("missing_data_ref", uncovered_attributes(required, html), REFERENCE_ITEMS),
        _warning("unknown_data_ref", unknown_references(attribute_values(html), required), REFERENCE_ITEMS),
        _warning("forbidden_internal_ids", internal_ids(html), REFERENCE_ITEMS),
    )
    return F.concat(F.array_compact(F.array(*found)), markup_warnings(html))


def notes_warnings(required: Column, notes: Column) -> Column:
    """The warnings of layout notes; blank ones have one warning only."""
    notes, required = text.strip(F.coalesce(notes, F.lit(""))), _references(required)

    def unknown(pattern: str) -> Column:
        return unknown_references(F.regexp_extract_all(notes, F.lit(f"({pattern})"), F.lit(1)), required)

    found = (
        _warning("missing_required_refs", uncovered_references(required, notes), REFERENCE_ITEMS),
        _warning("forbidden_internal_ids", internal_ids(notes), REFERENCE_ITEMS),
        _warning("unknown_image_refs", unknown(IMAGE_REFERENCE), REFERENCE_ITEMS),
        _warning("unknown_paragraph_refs", unknown(PARAGRAPH_REFERENCE), REFERENCE_ITEMS),
    )
    return F.when(notes == "", F.array(F.lit("layout_notes_missing_or_empty"))).otherwise(F.array_compact(F.array(*found)))


def _references(required: Column) -> Column:
    return F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda r: F.coalesce(r, F.lit("")) != "")


def coverage_appendix(notes: Column, required: Column) -> Column:
    """Notes, with all required references below as a JSON list if one isn't mentioned."""
    notes, required = F.coalesce(notes, F.lit("")), _references(required)
    spelled = F.transform(required, lambda r: F.regexp_replace(F.to_json(F.array(r)), r"^\[|\]$", ""))
    listed = F.concat(F.lit("[\n  "), F.array_join(spelled, ",\n  "), F.lit("\n]"))
    above = F.when(notes == "", "").otherwise(F.concat(notes, F.lit("\n\n")))
    return F.when(F.size(uncovered_references(required, notes)) > 0, F.concat(above, F.lit(CHECKLIST), listed)).otherwise(notes)


def allowed_fragment(fragment: str, pool: str, squeezed: str, sign: str | None = None) -> bool:
    """Whether a fragment stands in the allowed text: as it is; without white space and case; without leading bullets; or, of a bilingual
    one, both sides of the first colon, slash or bar of any kind. A colon belongs to what it ends. squeezed: the pool without
    white space, in lower case. sign: what parts the two languages, where that is known (empty: there is one language only); no
    other sign does then, nor any within a side."""
    import re

    def stands(t: str) -> bool:
        return t in pool or re.sub(r"\s+", "", t).lower() in squeezed

    t = " ".join(fragment.split()) if fragment else ""
    bare = re.sub(r"^[\s•·●⚫\-–—]+", "", t)
    if not t or stands(t) or (bare and stands(bare)) or (len(t) <= 2 and re.fullmatch(r"[\s\d\W]+", t)):
        return True
    if not re.search("[一-鿿]", t) or not re.search("[A-Za-z]", t):
        return False
    within = None if sign is None else ""
    for at in sorted({t.find(s) for s in (SEPARATORS if sign is None else sign)} - {-1}):
        left, right = t[:at].strip(), t[at + 1 :].strip()
        if left and right and allowed_fragment(left + t[at] * (t[at] in "：:"), pool, squeezed, within) and allowed_fragment(right, pool, squeezed, within):
            return True
    return False


def extra_text(fragments: DataFrame, pools: DataFrame, page: str = "page_id") -> DataFrame:
    """page, extra: the distinct fragments of a page that its allowed text doesn't have, in order, up to 40. A page without allowed
    text isn't checked.

    fragments: page, pos, text and, where it is known, sign; pools: page, pool. Only what nearly every fragment passes is checked in the JVM; the bilingual rule is
    recursive and runs on the few others, in Arrow batches."""
    bad = unallowed(fragments, pools, page)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", text.normalize(F.col("text")).alias("t")))), lambda s: s["t"])
    return bad.groupBy(page).agg(F.slice(F.array_distinct(listed), 1, MOST_TEXTS).alias("extra"))


def unallowed(fragments: DataFrame, pools: DataFrame, page: str = "page_id") -> DataFrame:
    """page, pos and text of the fragments that ``allowed_fragment`` doesn't find in their page's allowed text. A pool is squeezed once."""
    known = pools.select(page, F.coalesce("pool", F.lit("")).alias("pool")).where(text.strip(F.col("pool")) != "").withColumn("squeezed", F.lower(text.squeeze(F.col("pool"))))
    bare = fragments.withColumn("_t", text.normalize(F.col("text"))).where((F.col("_t") != "") & ~text.is_trivial(F.col("_t")))
    plain = F.contains("pool", F.col("_t")) | F.contains("squeezed", F.lower(text.squeeze(F.col("_t"))))
    sign = F.col("sign") if "sign" in fragments.columns else F.lit(None).cast("string")
    rest = bare.withColumn("sign", sign).join(known, page).where(~plain).select(page, "pos", "text", "pool", "squeezed", "sign")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            signs = [x if isinstance(x, str) else None for x in b["sign"]]
            keep = [not allowed_fragment(t, p, s, x) for t, p, s, x in zip(b["text"], b["pool"], b["squeezed"], signs, strict=True)]
            yield b.loc[keep, [page, "pos", "text"]]

    ship(rest.sparkSession)
    return rest.mapInPandas(run, rest.select(page, "pos", "text").schema)


#: Bytes of passages that a task looks for at once; more are looked for in further passes.
PASSAGE_BYTES = 1 << 26


def containing(texts: DataFrame, passages: DataFrame, most_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """(text_id, passage_id) of each text that contains a passage as it is. texts: text_id, text; passages: passage_id, passage.

    Passages are dealt to blocks of about ``most_bytes``; a block is one automaton, sent to every task, which finds all its passages in
    one walk over a text. Empty passages and null ones are found nowhere."""
    import ahocorasick

    ship(texts.sparkSession)
    some = passages.where(F.length("passage") > 0).select("passage_id", "passage")
    total = some.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    blocks = max(1, -(-total // most_bytes))
    ids = dict(passages.dtypes)["passage_id"]
    out = None
    for block in range(blocks):
        held: dict[str, list] = {}
        for r in some.where(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == block).collect():
            held.setdefault(r["passage"], []).append(r["passage_id"])

        def run(batches: Iterator[pd.DataFrame], held: dict[str, list] = held) -> Iterator[pd.DataFrame]:
            automaton = ahocorasick.Automaton()
            for passage, numbers in held.items():
                automaton.add_word(passage, numbers)
            automaton.make_automaton()
            for b in batches:
                found = [(i, n) for i, t in zip(b["text_id"], b["text"], strict=True) if t and held for n in sorted({n for _, ns in automaton.iter(t) for n in ns})]
                yield pd.DataFrame(found, columns=["text_id", "passage_id"])

        part = texts.select("text_id", "text").mapInPandas(run, f"text_id {dict(texts.dtypes)['text_id']}, passage_id {ids}")
        out = part if out is None else out.unionByName(part)
    return out


def overflows(scroll: Column, client: Column) -> Column:
    return scroll > client + TOLERANCE


def page_report(measured: DataFrame, extra: DataFrame) -> DataFrame:
    """page, ok, overflow, clipped (arrays), extra and summary (empty if ok) of measured pages and elements.

    measured: page, kind ("page" or "element"), ref, tag, cls, overflow_x and overflow_y (each may be lacking), scroll_w, client_w, scroll_h,
    client_h, text; extra: page, extra. Clipped elements are such as have a text and a size and don't show what exceeds them; they stand
    in order of the height by which they exceed their box, the largest first, with the first 90 characters of their text."""
    for column in ("tag", "cls", "overflow_x", "overflow_y"):
        if column not in measured.columns:
            measured = measured.withColumn(column, F.lit(None).cast("string"))
    out = overflows(F.col("scroll_w"), F.col("client_w")) | overflows(F.col("scroll_h"), F.col("client_h"))
    sizes = [F.col(c) for c in ("scroll_h", "client_h", "scroll_w", "client_w")]
    shown = text.strip(F.coalesce("text", F.lit("")))
    element = F.struct((F.col("client_h") - F.col("scroll_h")).alias("o"), "ref", "tag", "cls", *sizes, F.substring(shown, 1, SAMPLE).alias("text"))
    hides = (F.coalesce("overflow_x", F.lit("hidden")) != "visible") | (F.coalesce("overflow_y", F.lit("hidden")) != "visible")
    clipped = (F.col("kind") == "element") & out & hides & (F.col("client_h") > 0) & (F.col("client_w") > 0) & (F.length(shown) > 0)
    agg = measured.groupBy("page").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") == "page") & out, F.struct("ref", *sizes)))).alias("overflow"),
        F.transform(F.array_sort(F.collect_list(F.when(clipped, element))), lambda s: s.dropFields("o")).alias("clipped"),
    )
    joined = agg.join(extra, "page", "left").withColumn("extra", F.coalesce("extra", F.array().cast("array<string>")))
    ok = (F.size("overflow") == 0) & (F.size("clipped") == 0) & (F.size("extra") == 0)
    return joined.select("page", ok.alias("ok"), "overflow", "clipped", "extra", report_summary().alias("summary"))


def report_summary() -> Column:
    """What a report's row says in one line: the first overflow, the most clipped elements, and the number of extra texts."""
    page = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(" "))

    def height(x: Column) -> Column:
        return F.concat(F.lit("h "), x["scroll_h"].cast("string"), F.lit("/"), x["client_h"].cast("string"))

    def shown(x: Column) -> Column:
        names = F.slice(F.filter(F.split(text.normalize(x["cls"]), " "), lambda c: c != ""), 1, 2)
        classes = F.when(F.size(names) > 0, F.concat(F.lit("."), F.array_join(names, "."))).otherwise("")
        ref = F.when(text.strip(F.coalesce(x["ref"], F.lit(""))) != "", F.concat(F.lit(' ref="'), text.strip(x["ref"]), F.lit('"'))).otherwise("")
        return F.concat(page, F.lit("clipped: "), F.coalesce(x["tag"], F.lit("")), classes, ref, F.lit(" "), height(x))

    first = F.get("overflow", F.lit(0))
    width = F.concat(F.lit(", w "), first["scroll_w"].cast("string"), F.lit("/"), first["client_w"].cast("string"))
    return F.concat_ws(
        " | ",
        F.when(F.size("overflow") > 0, F.concat(page, F.lit("overflow: "), height(first), width)),
        F.transform(F.slice("clipped", 1, SUMMARY_ITEMS), shown),
        F.when(F.size("extra") > 0, F.concat(page, F.lit("extra_text: "), F.size("extra").cast("string"))),
    )
