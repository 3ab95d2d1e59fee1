"""The parse job: files to parsed documents, a row each. A file that cannot be parsed is a row with a result code, never a failed task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docwarp.functions.parsed import PARAGRAPHS, TABLES

#: Elements that end a paragraph, and those whose content is no text.
_ENDS = frozenset("p div section article header footer main h1 h2 h3 h4 h5 h6 li ul ol dl dt dd br hr blockquote pre tr table title body".split())
_HIDDEN = frozenset(("script", "style", "noscript", "template"))
SCHEMA = f"id bigint, parse_result_code string, parser_name string, parser_version string, file_type string, images bigint, error string, warnings array<string>, paragraphs {PARAGRAPHS}, tables {TABLES}"


class _Page(HTMLParser):
    """Paragraphs with the title of the heading above them, and tables where they stand."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.paragraphs: list[dict] = []
        self.tables: list[dict] = []
        self.text: list[str] = []
        self.title: str | None = None
        self.open: list[dict] = []  # tables that are not closed yet
        self.hidden = self.images = 0
        self.nested = False

    def _end(self, heading: bool = False) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text and self.open:
            rows = self.open[-1]["rows"]
            if not rows:
                rows.append([])
            rows[-1].append(text)
        elif text:
            if heading:
                self.title = text
            self.paragraphs.append({"index": len(self.paragraphs), "text": text, "page_number": None, "section_title": self.title})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "img":
            self.images += 1
        elif tag in _ENDS or tag in ("td", "th"):
            self._end()
        if tag == "table":
            self.nested |= bool(self.open)
            self.open.append({"rows": [], "merged": False, "paragraph_index": len(self.paragraphs) - 1 if self.paragraphs else None})
        elif tag == "tr" and self.open:
            self.open[-1]["rows"].append([])
        elif tag in ("td", "th") and self.open:
            self.open[-1]["merged"] |= any(k in ("rowspan", "colspan") and v not in (None, "", "1") for k, v in attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(self.hidden - 1, 0)
        elif tag in _ENDS or tag in ("td", "th"):
            self._end(heading=len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
        if tag == "table" and self.open:
            self._shut()

    def _shut(self) -> None:
        t = self.open.pop()
        rows = [r for r in t["rows"] if r]
        if rows:
            self.tables.append({"index": len(self.tables), "rows": rows, "paragraph_index": t["paragraph_index"], "page_number": None, "declared_rows": None, "declared_columns": None, "merged": t["merged"]})

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)

    def finish(self) -> None:
        self.close()
        self._end()
        while self.open:
            self._shut()


def parse_html(data: str) -> dict:
    """paragraphs, tables, images and warnings of a page."""
    page = _Page()
    page.feed(data)
    page.finish()
    warnings = ["MERGED_CELLS_PRESENT"] * any(t["merged"] for t in page.tables) + ["NESTED_TABLE_FLATTENED"] * page.nested
    return {"paragraphs": page.paragraphs, "tables": page.tables, "images": page.images, "warnings": warnings}


def outcome(doc: dict) -> tuple[str, list[str]]:
    """(result code, more warnings) by what there is to read: no text with images needs recognition, no text at all is empty."""
    text = "".join(p["text"] for p in doc["paragraphs"]) + "".join(c for t in doc["tables"] for r in t["rows"] for c in r)
    if not text.strip():
        return ("OCR_REQUIRED" if doc["images"] else "EMPTY_DOCUMENT"), []
    return "TEXT_EXTRACTED", ["POSSIBLE_SCANNED_DOCUMENT"] * (doc["images"] >= 3 and len(text.strip()) < 200)


def parse(files: DataFrame, parser: Callable[[str], dict] = parse_html, name: str = "html", version: str = "1") -> DataFrame:
    """A row per file (id, data): SCHEMA. Null data is an empty document; whatever a parser raises is PARSE_FAILED with the error's name."""
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row = {"id": batch.column(0)[i].as_py(), "parser_name": name, "parser_version": version, "file_type": name}
                try:
                    doc = parser(batch.column(1)[i].as_py() or "")
                    code, more = outcome(doc)
                    row |= {"parse_result_code": code, "paragraphs": doc["paragraphs"], "tables": doc["tables"], "images": doc["images"], "warnings": sorted({*doc["warnings"], *more})}
                except Exception as e:  # one bad file must not stop the others
                    row |= {"parse_result_code": "PARSE_FAILED", "error": type(e).__name__, "paragraphs": [], "tables": [], "images": 0, "warnings": []}
                rows.append(row)
                if len(rows) == 500:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("id", "data").mapInArrow(run, SCHEMA)
