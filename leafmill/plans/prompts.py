"""The texts that models are asked with, as column expressions over a request's fields.

Every builder takes structs or arrays and spells them as JSON, so that a request is data until it is written. Answers that are
shown again are cut, as they may be of any length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import capped

#: Code points of an earlier answer in a question, by what was asked for, and items in a list of problems.
JSON_ANSWER, HTML_ANSWER, PAGE_HTML = 6000, 1500, 18000
CLIPPED_ITEMS, EXTRA_ITEMS = 6, 12
CUT = "\n...(truncated)...\n"

TRANSLATION_RULES = (
    "Answer with one JSON object and nothing around it.",
    "Its fields are zh_paragraphs, en_paragraphs and sources, and no others; the three arrays are equally long.",
    "sources[i] lists the ids of the fragments that paragraph i is made of; every id of the input is used once, and no other id.",
    "A Chinese paragraph consists of its fragments, reordered or joined, without new wording; en_paragraphs[i] translates zh_paragraphs[i].",
)
PAGE_RULES = (
    "Answer with HTML only, between a first line <!-- PAGE_START --> and a last line <!-- PAGE_END -->, without code fences.",
    'Between them stands exactly one <div class="page">.',
)
CONTENT_RULES = (
    "Every zh and en of text_paragraphs stands on the page character for character, the Chinese before the English; it may be divided among lines and tags.",
    "The page has no other text; nothing is read off pictures.",
    "Every name in required_refs.all is the data-ref of an element, and no other name is.",
    "No scrolling, no hidden text, no style elements, no new style sheets, no background images or url(), no absolute positions.",
)


def pretty(c: Column) -> Column:
    return F.to_json(c, {"pretty": "true"})


def _rules(rules: tuple[str, ...]) -> Column:
    return F.lit("".join(f"- {r}\n" for r in rules))


def _section(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"{name}:\n"), F.coalesce(body, F.lit("")), F.lit("\n\n"))


def request(payload: Column) -> Column:
    """A first question."""
    return F.concat(F.lit("Input JSON:\n"), pretty(payload), F.lit("\n"))


def translation_repair(payload: Column, answer: Column, problem: Column) -> Column:
    """A question for a translation anew, after one that a check refused."""
    return F.concat(
        _section("The answer was refused", problem),
        _section("Rules", _rules(TRANSLATION_RULES)),
        _section("The refused answer", capped(answer, JSON_ANSWER, CUT)),
        _section("Input JSON", pretty(payload)),
    )


def format_repair(question: Column, answer: Column) -> Column:
    """A question for a page anew, after an answer without a page. An empty answer isn't shown."""
    shown = capped(answer, HTML_ANSWER, CUT)
    return F.concat(
        _section("The answer had no page between markers. Rules", _rules(PAGE_RULES)),
        _section("The input", question),
        F.when(shown != "", _section("The refused answer", shown)).otherwise(""),
    )


def notes_request(page: Column, required: Column) -> Column:
    """A question for a page's layout notes that mention each required reference."""
    asked = "Write plain text on the page's structure, short and without measures. Mention every name below, and refer to texts and images by these names only.\n"
    return F.concat(_section("meta_json", pretty(page)), F.lit(asked), _section("required_refs.all", pretty(required)))


def problems(overflow: Column, clipped: Column, extra: Column) -> Column:
    """The problems of a page's report (``validate.page_report``), one in a line: its first overflow, the most clipped elements, and
    texts that it shouldn't have."""

    def sizes(x: Column) -> Column:
        return F.format_string("h %d/%d, w %d/%d", x["scroll_h"], x["client_h"], x["scroll_w"], x["client_w"])

    def element(x: Column) -> Column:
        named = F.concat_ws(" ", *(F.concat(F.lit(f"{label}="), F.nullif(x[field], F.lit(""))) for label, field in (("tag", "tag"), ("class", "cls"), ("data-ref", "ref"))))
        return F.concat(F.lit("- Clipped text: "), named, F.lit(" "), sizes(x))

    over = F.transform(F.slice(overflow, 1, 1), lambda x: F.concat(F.lit("- Page overflow: "), sizes(x)))
    inside = F.transform(F.slice(clipped, 1, CLIPPED_ITEMS), element)
    more = F.transform(F.slice(extra, 1, EXTRA_ITEMS), lambda t: F.concat(F.lit("- Text that isn't the page's: "), F.to_json(F.array(t))))
    return F.array_join(F.concat(over, inside, more), "\n")


def page_repair(page: Column, html: Column, report: Column, notes: Column, styles: Column, least_font: float = 11.0, least_scale: float = 0.6, steps: int = 8) -> Column:
    """A question for a page that keeps within its boxes. report: struct(overflow, clipped, extra); page: struct of the page's record;
    notes: condensed; styles: what the style sheet offers."""
    found = problems(report["overflow"], report["clipped"], report["extra"])
    return F.concat(
        _section("The page as it is", capped(html, PAGE_HTML, CUT)),
        _section("Measured after shrinking", pretty(report)),
        _section("Problems", F.when(found == "", "none").otherwise(found)),
        _section("Change the page as little as needed, so that nothing overflows or is clipped after shrinking", F.lit(f"smallest font {least_font:g} pt, smallest scale {least_scale:g}, {steps} steps")),
        _section("Layout notes", notes),
        _section("meta_json", pretty(page)),
        _section("Classes of the style sheet", styles),
        _section("Rules", _rules(PAGE_RULES + CONTENT_RULES)),
    )
