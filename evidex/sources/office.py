"""Office files (DOCX, PPTX, XLSX) as block and cell tables, by their zip and XML parts; and small writers of them.

Sizes are held to bounds before anything is unpacked; a file that is not readable is a row of type 'error'.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes unpacked of a file and of one part of it at most.
LARGEST, PART = 200 << 20, 50 << 20
#: Rows of a batch that goes back to Spark, about: what a worker holds of the files that it has read.
OUT = 20_000
#: Points of an EMU, the unit of slides.
EMU = 12700.0
BLOCKS = "id long, place long, type string, level long, body string, x0 double, y0 double"
CELLS = "id long, sheet string, row long, col long, kind string, value string, formula string"


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element | None, name: str, default: str = "") -> str:
    if e is None:
        return default
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def _first(e: ET.Element, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if _tag(c) == name), None)
        if e is None:
            return None
    return e


def _all(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (c for c in e.iter() if _tag(c) == name)


class Package:
    """Parts of a package; every one is parsed once it is asked for."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        sizes = [i.file_size for i in self.zip.infolist()]
        if sum(sizes) > LARGEST or max(sizes, default=0) > PART:
            raise ValueError("too large")

    def part(self, name: str) -> ET.Element:
        return ET.fromstring(self.zip.read(name))

    def relations(self, name: str) -> dict[str, str]:
        """Relation id -> part that a part refers to."""
        folder, _, file = name.rpartition("/")
        rels = f"{folder}/_rels/{file}.rels".lstrip("/")
        if rels not in self.zip.namelist():
            return {}
        out = {}
        for r in self.part(rels):
            target = r.attrib["Target"]
            out[r.attrib["Id"]] = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}".lstrip("/")
        return out


def _text(e: ET.Element, name: str = "t") -> str:
    return "".join(t.text or "" for t in _all(e, name))


def docx_blocks(raw: bytes) -> Iterator[tuple]:
    """Paragraphs (headings by style, list items), tables as rows of cells; deleted revisions are left out."""
    for e in _first(Package(raw).part("word/document.xml"), "body"):
        if _tag(e) == "tbl":
            rows = ["\t".join(_text(c) for c in r if _tag(c) == "tc") for r in e if _tag(r) == "tr"]
            yield "table", 0, "\n".join(rows), None, None
        elif _tag(e) == "p":
            style = _attr(_first(e, "pPr", "pStyle"), "val")
            m = re.fullmatch(r"[Hh]eading ?([1-9])", style)
            kind = "heading" if m else "list_item" if _first(e, "pPr", "numPr") is not None else "paragraph"
            if text := _text(e):
                yield kind, int(m[1]) if m else 0, text, None, None


def pptx_blocks(raw: bytes) -> Iterator[tuple]:
    """Shapes of the slides in the order of the presentation: titles as headings; places in points."""
    p = Package(raw)
    rels = p.relations("ppt/presentation.xml")
    for s in _all(p.part("ppt/presentation.xml"), "sldId"):
        for shape in _all(p.part(rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))]), "sp"):
            title = _attr(_first(shape, "nvSpPr", "nvPr", "ph"), "type") in ("title", "ctrTitle")
            off = _first(shape, "spPr", "xfrm", "off")
            place = (float(_attr(off, "x", "0")) / EMU, float(_attr(off, "y", "0")) / EMU) if off is not None else (None, None)
            text = "\n".join(_text(q) for q in _all(shape, "p"))
            if text:
                yield "heading" if title else "paragraph", 1 if title else 0, text, *place


def column_number(name: str) -> int:
    """A -> 1, Z -> 26, AA -> 27."""
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def shifted(formula: str, rows: int, cols: int) -> str:
    """A shared formula as it stands so many rows and columns further on; parts after a dollar sign stay."""

    def move(m: re.Match) -> str:
        c, r = m[2] if m[1] else column_name(column_number(m[2]) + cols), m[4] if m[3] else str(int(m[4]) + rows)
        return f"{m[1]}{c}{m[3]}{r}"

    return re.sub(r"(\$?)\b([A-Z]{1,3})(\$?)([0-9]+)\b(?!\()", move, formula)


def xlsx_cells(raw: bytes) -> Iterator[tuple]:
    """Cells of all sheets with kind, value and formula; shared strings and shared formulas are written out."""
    p = Package(raw)
    rels = p.relations("xl/workbook.xml")
    shared = [_text(s) for s in p.part("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in p.zip.namelist() else []
    for sheet in _all(p.part("xl/workbook.xml"), "sheet"):
        base: dict[str, tuple[str, int, int]] = {}
        for c in _all(p.part(rels[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]), "c"):
            m = re.fullmatch(r"([A-Z]+)([0-9]+)", c.attrib["r"])
            row, col = int(m[2]), column_number(m[1])
            kind, f = c.attrib.get("t", "n"), _first(c, "f")
            value = _text(c, "t") if kind == "inlineStr" else (_first(c, "v").text if _first(c, "v") is not None else None)
            if kind == "s":
                value = shared[int(value)]
            formula = f.text if f is not None else None
            if f is not None and f.attrib.get("t") == "shared":
                if formula:
                    base[f.attrib["si"]] = formula, row, col
                else:
                    text, r0, c0 = base[f.attrib["si"]]
                    formula = shifted(text, row - r0, col - c0)
            yield sheet.attrib["name"], row, col, {"s": "string", "inlineStr": "string", "b": "boolean", "e": "error"}.get(kind, "number"), value, formula


def _over(files: DataFrame, read: Callable, schema: str, error: tuple) -> DataFrame:
    """Rows that ``read`` makes of each file (id, content), or one row of what ``error`` says."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in schema.split(", ")]
        for df in it:
            out = []
            for i, raw in zip(df["id"], df["content"], strict=True):
                try:
                    rows = list(read(bytes(raw or b"")))
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, AttributeError, TypeError, IndexError):
                    rows = [error]
                out += [(i, *r) for r in rows] if "place" not in columns else [(i, n, *r) for n, r in enumerate(rows)]
                if len(out) >= OUT:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    return files.select("id", "content").mapInPandas(run, schema)


def docx(files: DataFrame) -> DataFrame:
    return _over(files, docx_blocks, BLOCKS, ("error", 0, None, None, None))


def pptx(files: DataFrame) -> DataFrame:
    return _over(files, pptx_blocks, BLOCKS, ("error", 0, None, None, None))


def xlsx(files: DataFrame) -> DataFrame:
    return _over(files, xlsx_cells, CELLS, ("", 0, 0, "error", None, None))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _rels(targets: list[str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="{t}"/>' for i, t in enumerate(targets)) + "</Relationships>"


def make_docx(title: str, lines: list[str]) -> bytes:
    para = lambda t, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    body = para(title, '<w:pStyle w:val="Heading1"/>') + "".join(map(para, lines))
    body += f"<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para(title)}</w:tc></w:tr></w:tbl>"
    return _zip({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>"})


def make_pptx(slides: list[tuple[str, str]]) -> bytes:
    """Slides of a title and a text; the presentation lists them in reverse order of their files."""
    a, p = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda t, ph, y: f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="127000" y="{y * 12700}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:txBody></p:sp>'
    n = len(slides)
    parts = {f"ppt/slides/slide{n - i}.xml": f"<p:sld {a} {p}><p:cSld><p:spTree>{shape(t, '<p:ph type=\"title\"/>', 20)}{shape(b, '', 90)}</p:spTree></p:cSld></p:sld>" for i, (t, b) in enumerate(slides)}
    order = "".join(f'<p:sldId id="{256 + i}" r:id="rId{n - i}"/>' for i in range(n))
    return _zip(parts | {"ppt/presentation.xml": f"<p:presentation {p} {_R}><p:sldIdLst>{order}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": _rels([f"slides/slide{i + 1}.xml" for i in range(n)])})


def make_xlsx(words: list[str]) -> bytes:
    """A sheet with words in column A, their lengths in B, a shared formula that doubles them in C."""
    rows = "".join(
        f'<row r="{i}"><c r="A{i}" t="s"><v>{i - 1}</v></c><c r="B{i}"><v>{len(w)}</v></c><c r="C{i}">' + (f'<f t="shared" si="0" ref="C1:C{len(words)}">B1*$B$1</f>' if i == 1 else '<f t="shared" si="0"/>') + f"<v>{len(w) * len(words[0])}</v></c></row>"
        for i, w in enumerate(words, 1)
    )
    return _zip({
        "xl/workbook.xml": f'<workbook {_R}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _rels(["worksheets/sheet1.xml"]),
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>", "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{escape(w)}</t></si>" for w in words) + "</sst>",
    })
