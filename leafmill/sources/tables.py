"""Tables, files and markup as DataFrames, and the sinks that write them."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.functions.geometry import DEFAULT_PAGE
from leafmill.sources.shipping import ship

#: Fixed value: an attribute that holds an image; and the folder that such images are written to.
DATA_IMAGE = r"(?i)\b(src|href)=([\"'])data:image/([^;]+);base64,([A-Za-z0-9+/=\s]++)\2"
ASSETS = "assets"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one record each, read by schema; broken ones are null rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """page, page_end and html of files named chunk_<from>_<to>.html. A file of several pages is an error."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("html"), F.col("_metadata.file_name").alias("name"))
    numbers = [F.regexp_extract("name", r"chunk_(\d+)_(\d+)\.html$", i).try_cast("long") for i in (1, 2)]
    rows = rows.select(numbers[0].alias("page"), numbers[1].alias("page_end"), "html").where("page is not null")
    one = F.when(F.col("page") == F.col("page_end"), F.col("page")).otherwise(F.raise_error(F.lit("a chunk file has several pages")).cast("long"))
    return rows.withColumn("page", one)


def rendered_pages(files: DataFrame, render: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows that an injected renderer gives for each file (path, content) of spark.read.format("binaryFile"), with the path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, *row) for path, content in zip(b["path"], b["content"], strict=True) for row in render(content)]
            yield pd.DataFrame(rows, columns=names)

    names = ["path", *(f.split()[0] for f in schema.split(", "))]
    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def page_size(css: Column) -> Column:
    """struct(w, h) in points of the @page rule, or the default."""
    pattern = r"@page\s*\{\s*size:\s*([0-9.]+)pt\s+([0-9.]+)pt\s*;"
    w, h = (F.nullif(F.regexp_extract(css, pattern, i), F.lit("")).try_cast("double") for i in (1, 2))
    return F.when(w.isNotNull() & h.isNotNull(), F.struct(w.alias("w"), h.alias("h"))).otherwise(F.struct(F.lit(DEFAULT_PAGE[0]).alias("w"), F.lit(DEFAULT_PAGE[1]).alias("h")))


def text_styles(sheets: DataFrame) -> DataFrame:
    """doc_id, ts, font_size_pt and color of the .tsN rules of style sheets (doc_id, css)."""
    rules = sheets.select("doc_id", F.explode(F.regexp_extract_all("css", F.lit(r"(\.ts\d+\s*\{[^}]*\})"), F.lit(1))).alias("rule"))
    size = F.nullif(F.regexp_extract("rule", r"font-size:([0-9.]+)pt", 1), F.lit("")).try_cast("double")
    color = F.nullif(F.trim(F.regexp_extract("rule", r"color:([^;]+);", 1)), F.lit(""))
    return rules.select("doc_id", F.regexp_extract("rule", r"\.(ts\d+)", 1).alias("ts"), size.alias("font_size_pt"), color.alias("color"))


def markup_without_images(html: Column) -> Column:
    """The inside of the outer element, without img elements."""
    inner = F.regexp_replace(html, r"(?is)^\s*<div[^>]*>(.*)</div>\s*$", "$1")
    return F.regexp_replace(inner, r"(?is)<img\b[^>]*>", "")


class VisibleText(HTMLParser):
    """The texts between tags, outside scripts, styles and noscript. within: only inside elements of this class."""

    HIDDEN = ("script", "style", "noscript")
    EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, within: str | None = None):
        super().__init__(convert_charrefs=True)
        self.within, self.depth, self.hidden, self.texts = within, 0, 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        if self.within and tag not in self.EMPTY and (self.depth or self.within in (dict(attrs).get("class") or "").split()):
            self.depth += tag == "div" or not self.depth

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN and self.hidden:
            self.hidden -= 1
        if self.within and self.depth and tag == "div":
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden and (self.depth or not self.within):
            self.texts.append(data)


def visible_text(pages: DataFrame, key: str, html: str, within: str | None = None) -> DataFrame:
    """key, pos (from 0) and text of the texts that a page shows, normalised; blank ones go. Markup needn't be well-formed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, page in zip(b[key], b[html], strict=True):
                parser = VisibleText(within)
                parser.feed(page or "")
                parser.close()
                texts = [t for t in (re.sub(r"[\s ]+", " ", x).strip() for x in parser.texts) if t]
                rows += [(k, i, t) for i, t in enumerate(texts)]
            yield pd.DataFrame(rows, columns=[key, "pos", "text"])

    kind = dict(pages.dtypes)[key]
    ship(pages.sparkSession)
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos long, text string")


def page_divs(documents: DataFrame, key: str, html: str, *others: str) -> DataFrame:
    """key, page (from 0) and div of each element <div id="page<n>">, found by the depth of div tags; one left open is an error.
    others: further columns of text to keep."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tags, begins = re.compile(r"<div\b|</div\s*>", re.I), re.compile(r"<div\b[^>]*\bid=\"page(\d+)\"[^>]*>", re.I)
        for b in batches:
            rows = []
            for k, page, *rest in zip(b[key], b[html], *(b[c] for c in others), strict=True):
                for begin in begins.finditer(page or ""):
                    depth = 0
                    for tag in tags.finditer(page, begin.start()):
                        depth += -1 if tag[0][1] == "/" else 1
                        if not depth:
                            rows.append((k, int(begin[1]), page[begin.start() : tag.end()], *rest))
                            break
                    else:
                        raise ValueError(f"page {begin[1]} isn't closed")
            yield pd.DataFrame(rows, columns=[key, "page", "div", *others])

    kind = dict(documents.dtypes)[key]
    ship(documents.sparkSession)
    return documents.select(key, html, *others).mapInPandas(run, ", ".join([f"{key} {kind}, page long, div string", *(f"{c} string" for c in others)]))


def page_chunks(documents: DataFrame, key: str, html: str) -> DataFrame:
    """key, page (from 1), name and html: a file of its own for each page of a document, with the document's head and a base that leads
    out of the chunks' folder, unless the head has one. A document without pages has no rows."""
    head = F.coalesce(text.present(F.regexp_extract(html, r"(?is)<head>.*?</head>", 0)), F.lit("<head></head>"))
    based = F.when(F.contains(F.lower(head), F.lit("<base")), head).otherwise(F.regexp_replace(head, r"(?is)^<head>", '<head>\n<base href="../">'))
    rows = page_divs(documents.select(key, F.col(html).alias("_html"), based.alias("_head")), key, "_html", "_head")
    page = F.col("page") + 1
    name = F.concat(F.lit("chunk_"), text.numbered(page), F.lit("_"), text.numbered(page), F.lit(".html"))
    return rows.select(key, page.alias("page"), name.alias("name"), document(F.col("_head"), page_block(F.col("div"))).alias("html"))


def page_block(div: Column) -> Column:
    """A page's element between page markers."""
    return F.concat(F.lit("<!-- PAGE_START -->\n"), div, F.lit("\n<!-- PAGE_END -->"))


def document(head: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.lit("<!doctype html>"), F.lit('<html lang="zh">'), head, F.lit("<body>"), body, F.lit("</body>"), F.lit("</html>"))


def styled_document(block: Column, title: Column, base: str, sheet: str = "css_library.css") -> Column:
    """A page block as a document by itself, with a base ("./" if empty) and a style sheet."""
    base = (base or "").strip() or "./"
    head = F.concat_ws(
        "\n",
        F.lit("<head>"),
        F.lit(f'<base href="{base.rstrip("/")}/">'),
        F.lit('<meta charset="utf-8" />'),
        F.lit('<meta name="viewport" content="width=device-width, initial-scale=1" />'),
        F.concat(F.lit("<title>"), F.coalesce(title, F.lit("")), F.lit("</title>")),
        F.lit(f'<link rel="stylesheet" href="{sheet}" />'),
        F.lit("</head>"),
    )
    return F.concat(document(head, text.strip(F.coalesce(block, F.lit("")))), F.lit("\n"))


def base_href(start: str, to: str) -> str:
    """How one folder is reached from another."""
    found = posixpath.relpath(to.replace("\\", "/"), start.replace("\\", "/"))
    return "./" if found == "." else found


def external_images(documents: DataFrame, key: str, html: str) -> tuple[DataFrame, DataFrame]:
    """(documents whose embedded images are links to files, the files (name, content), each content once).

    A file is named by its content. Images that aren't valid base64 stay where they are."""

    def part(attribute: Column, i: int) -> Column:
        return F.regexp_extract(attribute, DATA_IMAGE, i)

    def content(attribute: Column) -> Column:
        packed = text.squeeze(part(attribute, 4))
        return F.when(F.length(packed) % 4 == 0, F.try_to_binary(packed, F.lit("base64")))

    def name(attribute: Column) -> Column:
        return F.concat(F.lit("embedded_"), F.substring(F.sha1(content(attribute)), 1, 16), text.mime_extension(part(attribute, 3)))

    def link(attribute: Column) -> Column:
        quote = part(attribute, 2)
        linked = F.concat(part(attribute, 1), F.lit("="), quote, F.lit(f"{ASSETS}/"), name(attribute), quote)
        return F.coalesce(linked, attribute)

    found = F.array_distinct(F.regexp_extract_all(html, F.lit(DATA_IMAGE), F.lit(0)))
    linked = documents.withColumn(html, F.aggregate(found, F.col(html), lambda t, attribute: F.replace(t, attribute, link(attribute))))
    images = documents.select(F.explode(found).alias("_a")).select(name(F.col("_a")).alias("name"), content(F.col("_a")).alias("content"))
    return linked, images.where("name is not null").dropDuplicates(["name"])


def page_range(pages: DataFrame, first: int, last: int = 0, number: str = "page", total: int | None = None) -> DataFrame:
    """Pages from first to last, counted from 1; a last that isn't positive means the end. Pages beyond the end aren't missed, unless the
    document's total is given: then a range that isn't within it is an error."""
    if first < 1 or 0 < last < first or (total is not None and max(first, last) > total):
        raise ValueError(f"no pages from {first} to {last}" + (f" of {total}" if total is not None else ""))
    return pages.where(F.col(number) >= first) if last <= 0 else pages.where(F.col(number).between(first, last))


#: What is answered for a file that isn't taken.
WRONG_SUFFIX, TOO_LARGE = 400, 413


def upload_status(path: Column, length: Column, suffix: str = ".pdf", most_mb: int = 50) -> Column:
    """Null for a file that may be processed, by its suffix in any case and its size; else the status of its rejection."""
    return F.when(~F.endswith(F.lower(path), F.lit(suffix)), WRONG_SUFFIX).when(length > most_mb * 1024 * 1024, TOO_LARGE)


def uploads(files: DataFrame, suffix: str = ".pdf", most_mb: int = 50) -> DataFrame:
    """Files (path, length) of spark.read.format("binaryFile") that may be processed."""
    return files.where(upload_status(F.col("path"), F.col("length"), suffix, most_mb).isNull())


def setting(spark: SparkSession, name: str, default):
    """A setting of the session under ``spark.leafmill.``, of the default's type, or the default."""
    value = spark.conf.get(f"spark.leafmill.{name}", None)
    if value is None or not value.strip():
        return default
    return value.strip().lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(value)


def image_texts(images: DataFrame, described: DataFrame) -> DataFrame:
    """page_id, name and content of the files of a page's images: a description, or a note that there is none. images: page_id, id, once
    each; described: page_id, pos, id, text; of a repeated id the last counts."""
    last = described.groupBy("page_id", "id").agg(F.max_by(text.strip(F.col("text")), "pos").alias("_text"))
    has = F.coalesce(F.col("_text"), F.lit("")) != ""
    name = F.concat(F.col("id"), F.when(has, ".text.txt").otherwise(".missing.txt"))
    content = F.concat(F.when(has, F.col("_text")).otherwise("missing description for this image id"), F.lit("\n"))
    return images.select("page_id", "id").join(last, ["page_id", "id"], "left").select("page_id", name.alias("name"), content.alias("content"))


def back_up(pages: DataFrame, path: str, turn: int) -> None:
    """Pages before a round of repairs overwrites them; a round's first copy stays."""
    pages.write.mode("ignore").parquet(f"{path.rstrip('/')}/round={turn}")


def page_markup(answers: DataFrame, key: str, raw: str) -> DataFrame:
    """key and block: of all stretches between a start and a later end sign, the one that looks most like a page, or null."""

    def best(answer: str | None) -> str | None:
        text = answer or ""
        starts = [m.end() for m in re.finditer(r"<!--\s*PAGE_START\s*-->", text, re.I)]
        ends = [m.start() for m in re.finditer(r"<!--\s*PAGE_END\s*-->", text, re.I)]
        found = [text[a:b].strip() for a in starts for b in ends if b > a]

        def looks(block: str) -> float:
            page = 5 * bool(re.search(r"class\s*=\s*[\"'][^\"']*\bpage\b", block, re.I)) + bool(re.search(r"id\s*=\s*[\"']page", block, re.I))
            return bool(re.search(r"<div\b", block, re.I)) + page + min(4.0, len(block) / 800)

        return max(found, key=looks) if found else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "block": [best(x) for x in b[raw]]})

    kind = dict(answers.dtypes)[key]
    ship(answers.sparkSession)
    return answers.select(key, raw).mapInPandas(run, f"{key} {kind}, block string")


def write_files(files: DataFrame, folder: str, keep: bool = False) -> None:
    """Write files (name, content as binary) below a folder that all executors share, given as a URI or a path: pictures, page chunks, image
    texts. A file is written beside its place and moved there, so a task that runs again leaves no half file. keep: what is there stays.
    Names that lead out of the folder are an error; a null content is an empty file."""
    unsafe = F.raise_error(F.concat(F.lit("not below the folder: "), "name")).cast("string")
    named = files.select(F.when(text.safe_relative_path(F.col("name")), F.col("name")).otherwise(unsafe).alias("name"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                path = f"{base.rstrip('/')}/{name}"
                if keep and system.get_file_info(path).type != fs.FileType.NotFound:
                    continue
                system.create_dir(posixpath.dirname(path), recursive=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content or b"")
                system.move(part, path)
            yield b[["name"]]

    ship(files.sparkSession)
    named.mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; text isn't escaped beyond what JSON asks for, and null fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def indented_json(record: Column) -> Column:
    """A record as JSON text over several lines."""
    return F.to_json(record, {"pretty": "true", "ignoreNullFields": "false"})


def write_report(reports: DataFrame, path: str) -> None:
    """Reports of pages as JSON, in the order of their pages within each file."""
    write_json(reports.repartitionByRange("page").sortWithinPartitions("page"), path)


def write_pages(df: DataFrame, path: str, page: str = "page") -> None:
    """One folder per page number."""
    df.repartition(page).write.mode("overwrite").partitionBy(page).format("text").save(path)


# ---- Derived inputs


def boxes(lineitem: DataFrame) -> DataFrame:
    """Boxes on pages of 960 by 540: page_id, ord, x, y, w, h, fill, one per order and line number.

    Rows are dealt by page once; grouping, windows and joins that have the page among their keys need no further shuffle."""
    used = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return used.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("ord")).agg(
        ((F.min("l_partkey") * 37) % 700).cast("double").alias("x"),
        ((F.min("l_suppkey") * 53) % 400).cast("double").alias("y"),
        (12 + F.max("l_quantity") * 8).alias("w"),
        (12 + F.max("l_discount") * 2400).alias("h"),
        F.min(F.concat("l_returnflag", "l_linestatus")).alias("fill"),
    )


def lines(documents: DataFrame) -> DataFrame:
    """Lines of documents with geometry: doc_id, ord, text, left, top, lh, kind. Blank lines go; ord counts them."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "v"))
    rows = rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("ord"), F.trim("v").alias("text")).where("text <> ''")
    size = F.length("text")
    return rows.select(
        "doc_id",
        "ord",
        "text",
        (10 + (size % 3) * 2.5).cast("double").alias("left"),
        (F.col("ord") * 14 + F.when(F.col("ord") % 7 == 0, 9).otherwise(0)).cast("double").alias("top"),
        F.when(F.col("ord") % 4 == 0, 0).otherwise(12).cast("double").alias("lh"),
        F.when(F.col("ord") == 1, "title").when(size % 11 == 0, "subheading").otherwise("body").alias("kind"),
    )
