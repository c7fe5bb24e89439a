"""Contents of presentation and PDF files as rows, one file at a time in Arrow batches.

A presentation is a zip archive of XML parts; the standard library reads it. A PDF needs a provider: a factory of a function from the
file's bytes to its pages, each a pair of words (text, x0, top) and the page's plain text, which counts where there are no words.
A file that can't be read gives no rows.
"""

from __future__ import annotations

import io
import logging
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)
PdfFactory = Callable[[], Callable[[bytes], list[tuple[list[tuple[str, float, float]], str]]]]

# Name spaces of the file format.
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


class _Deck:
    """The parts of a presentation and their relations."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, part: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(part))

    def related(self, part: str) -> dict[str, tuple[str, str]]:
        """Relation id -> (kind, part)."""
        folder, name = posixpath.split(part)
        where = f"{folder}/_rels/{name}.rels"
        if where not in self.names:
            return {}
        found = self.xml(where).iter(f"{_REL}Relationship")
        return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/")) for r in found}

    def slides(self) -> Iterator[str]:
        relations = self.related("ppt/presentation.xml")
        for entry in self.xml("ppt/presentation.xml").iter(f"{_P}sldId"):
            if entry.get(f"{_R}id") in relations:
                yield relations[entry.get(f"{_R}id")][1]


def _shapes(root: ElementTree.Element) -> Iterator[tuple[ElementTree.Element, int | None, int | None]]:
    """Shapes of a slide or layout: the element, its placeholder's index (None: no placeholder) and its top."""
    for shape in root.iterfind(f"{_P}cSld/{_P}spTree/{_P}sp"):
        holder, offset = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph"), shape.find(f"{_P}spPr/{_A}xfrm/{_A}off")
        yield shape, None if holder is None else int(holder.get("idx", "0")), None if offset is None else int(offset.get("y", "0"))


def _paragraphs(shape: ElementTree.Element) -> list[str]:
    def text(paragraph: ElementTree.Element) -> str:
        return "".join("\n" if e.tag == f"{_A}br" else e.findtext(f"{_A}t") or "" for e in paragraph if e.tag in (f"{_A}r", f"{_A}br", f"{_A}fld"))

    return [text(p) for p in shape.iterfind(f"{_P}txBody/{_A}p")]


def slide_shapes(data: bytes) -> list[tuple[int, int, bool, list[str]]]:
    """(slide, top, is_title, paragraphs) of every shape with text; a placeholder without a place has its layout's."""
    deck, out = _Deck(data), []
    for number, part in enumerate(deck.slides(), 1):
        layouts = [target for kind, target in deck.related(part).values() if kind == "slideLayout" and target in deck.names]
        inherited = {index: top for layout in layouts for _, index, top in _shapes(deck.xml(layout)) if index is not None}
        for shape, index, top in _shapes(deck.xml(part)):
            out.append((number, (inherited.get(index) if top is None else top) or 0, index == 0, _paragraphs(shape)))
    return out


def _rows(files: DataFrame, read: Callable[[], Callable[[bytes], list[tuple]]], schema: pa.Schema, ddl: str) -> DataFrame:
    """files: (doc_id, content). read's rows of each file behind its doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = read()
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = [(name, *row) for row in reader(data)]
                except Exception:
                    log.exception("%s can't be read.", name)
                    continue
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return files.select("doc_id", "content").mapInArrow(run, ddl)


def presentation_shapes(files: DataFrame) -> DataFrame:
    """files: (doc_id string, content) to the rows that sources.documents.from_slides takes."""
    schema = pa.schema([("doc_id", pa.string()), ("slide", pa.int32()), ("top", pa.int64()), ("is_title", pa.bool_()), ("paragraphs", pa.list_(pa.string()))])
    return _rows(files, lambda: slide_shapes, schema, "doc_id string, slide int, top long, is_title boolean, paragraphs array<string>")


def pdf_words(files: DataFrame, factory: PdfFactory) -> DataFrame:
    """files: (doc_id string, content) to the rows that sources.documents.from_pdf_words takes; a page without words is one of its text."""

    def reader() -> Callable[[bytes], list[tuple]]:
        pages = factory()

        def rows(data: bytes) -> list[tuple]:
            return [(number, text, float(x0), float(top)) for number, (words, plain) in enumerate(pages(data), 1) for text, x0, top in (words or [(plain or "", 0.0, 0.0)])]

        return rows

    schema = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("x0", pa.float64()), ("top", pa.float64())])
    return _rows(files, reader, schema, "doc_id string, page int, text string, x0 double, top double")
