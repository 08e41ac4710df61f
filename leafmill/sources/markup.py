"""Page markup as records: containers, images and lines of text with their runs, read out of documents that needn't be well-formed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.sources.shipping import ship

#: Elements without an end, and such as end an open paragraph.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center dir div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

PLACE = "x: double, y: double, w: double, h: double"
CONTAINERS = f"array<struct<id: string, {PLACE}, fill: string>>"
IMAGES = f"array<struct<id: string, src: string, {PLACE}>>"
LINES = "array<struct<ord: int, style: string, container: string, runs: array<struct<text: string, bold: boolean, ts: string>>>>"

_PLACE = [(c, pa.float64()) for c in "xywh"]
_RUN = pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("ts", pa.string())])
_KINDS = {
    "containers": pa.list_(pa.struct([("id", pa.string()), *_PLACE, ("fill", pa.string())])),
    "images": pa.list_(pa.struct([("id", pa.string()), ("src", pa.string()), *_PLACE])),
    "lines": pa.list_(pa.struct([("ord", pa.int32()), ("style", pa.string()), ("container", pa.string()), ("runs", pa.list_(_RUN))])),
}


def number(value: str | None) -> float:
    """An attribute's number; 0 where it is none."""
    try:
        return float(value or 0.0)
    except ValueError:
        return 0.0


class PageReader(HTMLParser):
    """The pages of a document: divs of class "page". A container or image is a div of that class inside a layer of its kind; a line is a
    paragraph, its runs the texts in it with the weight and the style class that hold for them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pages: list[dict] = []
        self.open: list[tuple[str, dict]] = []  # element, what begins with it
        self.names: Counter = Counter()
        self.inside: Counter = Counter()  # open layers
        self.page: dict | None = None
        self.line: dict | None = None
        self.bold, self.ts = 0, [None]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_PARAGRAPH and self.names["p"]:
            self.end("p")
        values = {k: v or "" for k, v in reversed(attrs)}
        classes = values.get("class", "").split()
        begins: dict = {}
        if tag == "div":
            if "page" in classes:
                begins["page"] = self.page
                self.page = {"page_id": values.get("id", ""), "containers": [], "images": [], "lines": []}
                self.pages.append(self.page)
            if self.page is not None and values.get("id"):
                place = {c: number(values.get(f"data-{c}")) for c in "xywh"}
                if "container" in classes and self.inside["container-layer"]:
                    self.page["containers"].append({"id": values["id"], **place, "fill": values.get("data-fill", "").strip() or None})
                if "image" in classes and self.inside["image-layer"]:
                    self.page["images"].append({"id": values["id"], "src": values.get("data-src", "").strip() or None, **place})
            begins["layers"] = [c for c in ("container-layer", "image-layer") if c in classes]
            self.inside.update(begins["layers"])
        elif tag == "p" and self.page is not None:
            self.line = {"ord": len(self.page["lines"]), "style": values.get("style"), "container": values.get("data-container") or None, "runs": []}
            self.page["lines"].append(self.line)
        elif tag in ("b", "strong"):
            begins["bold"] = True
            self.bold += 1
        elif tag == "span":
            begins["ts"] = True
            self.ts.append(next((c for c in classes if c.startswith("ts")), self.ts[-1]))
        if tag not in EMPTY:
            self.open.append((tag, begins))
            self.names[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag]:
            self.end(tag)

    def end(self, name: str) -> None:
        while True:
            tag, begins = self.open.pop()
            self.names[tag] -= 1
            if "page" in begins:
                self.page = begins["page"]
            self.inside.subtract(begins.get("layers", ()))
            self.bold -= "bold" in begins
            if "ts" in begins:
                self.ts.pop()
            if tag == "p":
                self.line = None
            if tag == name:
                return

    def handle_data(self, data: str) -> None:
        if self.line is not None:
            self.line["runs"].append({"text": data.replace("\n", " "), "bold": self.bold > 0, "ts": self.ts[-1]})


def page_records(documents: DataFrame, key: str, html: str, *others: str) -> DataFrame:
    """key, page (from 0), page_id, containers, images and lines of each page of a document. others: further columns to keep.

    Containers and images without an id go; one without a source has a null one. A null document has no pages; elements that are left
    open end with the document."""
    names = [key, "page", "page_id", "containers", "images", "lines", *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = []
            rows: list[int] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                reader = PageReader()
                reader.feed(text or "")
                reader.close()
                found += [{"page": n, **p} for n, p in enumerate(reader.pages)]
                rows += [i] * len(reader.pages)
            at = pa.array(rows, pa.int64())
            columns = [pa.array([p["page"] for p in found], pa.int64()), pa.array([p["page_id"] for p in found], pa.string())]
            columns += [pa.array([p[c] for p in found], kind) for c, kind in _KINDS.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *columns, *(c.take(at) for c in batch.columns[2:])], names=names)

    ship(documents.sparkSession)
    kinds = dict(documents.dtypes)
    schema = [f"{key} {kinds[key]}", "page long", "page_id string", f"containers {CONTAINERS}", f"images {IMAGES}", f"lines {LINES}", *(f"{c} {kinds[c]}" for c in others)]
    return documents.select(key, html, *others).mapInArrow(run, ", ".join(schema))
