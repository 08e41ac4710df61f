"""Main text of web pages by two-pass block rules.

The markup is cut into blocks at block-level tags. The first pass classifies a block by stop-word density, length and link
density; the element that it stands in is one feature more, which moves the thresholds. Blocks too short to tell inherit, in
the second pass, the label of the nearest decided neighbours, those of the same article first.
What menus, headers, footers, sidebars, notices, adverts, forms and comments hold is no content whatever it reads like.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near"
#: Of the first pass: characters, shares of linked characters and of stop words. In an article prose may have any share of stop words,
#: as code, tables and languages without a list of them have none.
LONG, SHORT_CHARS, MOST_LINKED, STOP_LOW, STOP_HIGH = 200, 70, 0.35, 0.1, 0.2

#: Elements whose text is no content: the text inside isn't markup (first) or is skipped with its markup.
RAW = frozenset("script style textarea title noscript template svg math iframe object canvas select button head".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset address".split())
CONTENT = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one, if only such stand between; the others hold them.
ENDS_ITSELF = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that mark an element as no content.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|paywall|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|sidebar|side|widget|related|recommended|"
    r"recommendations|share|sharing|social|comment|comments|reply|replies|disqus|footer|header|masthead|copyright|legal|disclaimer|search|skip|toc|tags|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)

#: Parts of a class that say what an article is about or allows, or how a page is laid out, not what the element is.
TELLS_NOTHING = re.compile(r"(?:^|\s)(?:(?:category|tag|type|post|format|status|has|with|no|without)-[^\s]*|[^\s]*-(?:open|closed|enabled|disabled|allowed))(?=\s|$)", re.I)
#: An article is marked by these whole names only.
MARKED_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments comment-body comment-item reply replies".split())

STOP_WORDS = frozenset(
    # Common function words of English, German, Spanish and French.
    """a about after all also an and any are as at be been but by can could did do for from had has have he her his i if in into is it its just more no not of on one
    only or other our out over she so some than that the their them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat haben ich ihr im in ist ja kann man mit nach nicht
    noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie wir zu zum zur
    al como con de del desde donde el ella en entre era es esta este están fue ha hay la las le lo los más me mi muy no nos o para pero por que qué se ser si sin
    sobre su sus también un una uno y ya
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur tu un une vous""".split()
)

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*?)(/?)(>|$)", re.S)
#: A tag with a quotation mark too many, or with signs in its attributes that belong to markup, ends at the next ">".
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*?)(/?)(>|$)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)
WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    article: int  # the number of the article that it is part of, or 0
    boilerplate: bool  # inside an element that holds no content
    heading: bool
    label: str = ""


def no_content(name: str, attributes: str) -> bool:
    """Whether an element holds no content by its name, its class, id or role, or because it isn't shown."""
    if name in BOILERPLATE:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            if name in CONTENT:
                if not MARKED_ARTICLE.isdisjoint(value.lower().split()):
                    return True
            elif MARKED.search(TELLS_NOTHING.sub(" ", value)):
                return True
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Open:
    """The open block elements, and what they make of a text inside; every step takes constant time on average."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int]] = []  # element, whether it holds no content, article around
        self.names: Counter = Counter()
        self.bad = self.headings = self.articles = 0

    def push(self, name: str, bad: bool) -> None:
        article = self.stack[-1][2] if self.stack else 0
        if name in CONTENT:
            self.articles += 1
            article = self.articles
        self.stack.append((name, bad, article))
        self.names[name] += 1
        self.bad += bad
        self.headings += name in HEADINGS

    def pop(self) -> str:
        name, bad, _ = self.stack.pop()
        self.names[name] -= 1
        self.bad -= bad
        self.headings -= name in HEADINGS
        return name

    def close(self, name: str) -> None:
        while self.pop() != name:
            pass

    def close_implied(self, name: str) -> None:
        """End the open element that a new one of this name ends."""
        ends, at = ENDS_ITSELF[name], len(self.stack)
        while at and self.stack[at - 1][0] in ENDS_ITSELF:  # a name stands there once at most
            at -= 1
            if self.stack[at][0] in ends:
                while len(self.stack) > at:
                    self.pop()
                return


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text in order. Character references are decoded, white space is one space."""
    out: list[Block] = []
    open_ = Open()
    held: list[str] = []
    endless: set[str] = set()  # elements that have no end further down
    linked = 0
    links = 0

    def close_block() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                article = open_.stack[-1][2] if open_.stack and not open_.bad else 0
                out.append(Block(text, min(linked, len(text)), article, open_.bad > 0, open_.headings > 0))
            held.clear()
        linked = 0

    def end_of(name: str, at: int) -> int | None:
        """Where the element ends; what is looked for in vain is looked for once."""
        if name in endless:
            return None
        end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
        if not end:
            endless.add(name)
        return end.end() if end else None

    at, size = 0, len(page)
    while at < size:
        cut = page.find("<", at)
        if cut < 0:
            cut = size
        if cut > at:
            held.append(page[at:cut])
            if links:
                linked += len(page[at:cut].strip())
        if cut == size:
            break
        tag = TAG.match(page, cut) or LOOSE.match(page, cut)
        if not tag:
            held.append("<")
            at = cut + 1
            continue
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if not tag[5]:
            break  # the page ends inside a tag
        if tag[1]:
            if name == "a":
                links = max(0, links - 1)
            if open_.names[name]:
                close_block()
                open_.close(name)
            continue
        if name in RAW:
            if not tag[4]:
                end = end_of(name, at)
                if end is not None:
                    at = end
                elif name == "head":  # its end may be left out
                    body = re.compile(r"<body\b", re.I).search(page, at) if "body" not in endless else None
                    if body:
                        at = body.start()
                    else:
                        endless.add("body")
                else:
                    at = size
            held.append(" ")
            continue
        if name == "br":
            held.append(" ")
        elif name == "a":
            links += 1
        elif name in BLOCK:
            close_block()
            if name in ENDS_ITSELF:
                open_.close_implied(name)
            if name not in VOID and not tag[4]:
                own = name != "header" or not (open_.names["article"] or open_.names["main"])  # an article's own header has its title
                open_.push(name, no_content(name if own else "", tag[3]))
        elif name in ("span", "small", "label", "ins", "i", "b") and no_content("", tag[3]):  # an inline element that is hidden or marked
            at = end_of(name, at) or at
    close_block()
    return out


def stop_words(text: str) -> float:
    """The share of stop words."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(block: Block) -> tuple[str, str]:
    """The block's own label, and what decides it. NEAR: likely, but a neighbour decides; SHORT: too short to tell."""
    if block.boilerplate:
        return BAD, "element"
    size = len(block.text)
    if block.linked / size > MOST_LINKED:
        return BAD, "link density"
    if "©" in block.text and size < LONG and not block.article:
        return BAD, "copyright"
    if size < SHORT_CHARS:
        return SHORT, ""
    stops = stop_words(block.text)
    if stops >= STOP_LOW if block.article else stops >= STOP_HIGH and size > LONG:
        return GOOD, "stop words"
    if block.article or stops >= STOP_LOW or size >= LONG:
        return NEAR, ""
    return BAD, "stop words"


def nearest_decided(first: list[str], articles: list[int]) -> list[tuple[int | None, int | None]]:
    """For each block the nearest decided ones before and after it; a block of an article sees only that article's."""

    def walk(order: Iterable[int]) -> list[int | None]:
        out: list[int | None] = [None] * len(first)
        last: dict[int, int] = {}  # by article, 0 for the page
        for i in order:
            out[i] = last.get(articles[i])
            if first[i] in (GOOD, BAD):
                last[0] = last[articles[i]] = i
        return out

    return list(zip(walk(range(len(first))), walk(range(len(first) - 1, -1, -1)), strict=True))


def labelled(blocks: list[Block]) -> list[Block]:
    """Both passes: SHORT and NEAR blocks take the label that the nearest decided blocks before and after them agree on. In an article
    they are content unless both its nearest blocks aren't. Elsewhere, where the two don't agree, the nearer one decides; of
    equally near ones, a NEAR block or a heading above content is content."""
    first = [first_pass(b)[0] for b in blocks]
    for i, (block, own, (a, b)) in enumerate(zip(blocks, first, nearest_decided(first, [b.article for b in blocks]), strict=True)):
        if own in (GOOD, BAD):
            block.label = own
        elif block.article:
            block.label = BAD if a is not None and b is not None and first[a] == first[b] == BAD else GOOD
        elif a is None and b is None:
            block.label = GOOD
        elif a is None or b is None:
            block.label = first[b if a is None else a] if own == SHORT else GOOD
        elif first[a] == first[b]:
            block.label = first[a] if own == SHORT or first[a] == GOOD else GOOD if len(block.text) > LONG else BAD
        elif block.heading and first[b] == GOOD:
            block.label = GOOD
        elif i - a != b - i:
            block.label = first[a] if i - a < b - i else first[b]
        else:
            block.label = GOOD if own == NEAR else BAD
    return blocks


def main_text(page: str | None) -> str:
    """The content blocks in page order, joined by line ends; a null page has none."""
    return "\n".join(b.text for b in labelled(blocks_of(page or "")) if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page, or one without content, has an empty text. Pages cut off inside a tag, comment or script lose that
    part only. Repeated rows keep a row each. Columns but page_id, url and html are not read.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
