"""Sources that need a parser: HTML, Markdown, e-mail, notebooks and undeclared encodings.

Each parser is a plain function from a text to blocks; the frames apply it to Arrow batches, one row a
block. A text that cannot be parsed gives one block of type 'error' instead of stopping the job.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that are skipped, headings with their levels, elements that are paragraphs, elements without an end.
HIDDEN = {"script", "style", "noscript", "template", "svg"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
TEXTS = {"p", "li", "blockquote", "pre"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: An opening tag of these ends an open paragraph where ``autoclose`` is set.
BLOCKS = {*HEADINGS, *TEXTS, "table", "div", "ul", "ol", "section", "article", "footer", "header", "nav", "main"}
Block = tuple[str, int, str]


class _Html(HTMLParser):
    def __init__(self, autoclose: bool):
        super().__init__(convert_charrefs=True)
        self.autoclose, self.out, self.stack, self.hidden = autoclose, [], [], 0
        #: Tag and depth of the block being read, its pieces; rows of a table.
        self.open: tuple[str, int] | None = None
        self.text: list[str] = []
        self.rows: list[list[str]] = []
        #: Of the block being read: its attributes, its links (target, pieces of the label); of each block that is out: id, classes, links.
        self.attrs: dict[str, str] = {}
        self.links: list[tuple[str, list[str]]] = []
        self.in_link = False
        self.details: list[tuple[str | None, list[str], list[tuple[str, str]]]] = []

    def emit(self) -> None:
        if not self.open:
            return
        tag, before = self.open[0], len(self.out)
        if tag == "table":
            rows = [[re.sub(r"\s+", " ", c).strip() for c in r] for r in self.rows]
            rows = [r for r in rows if any(r)]
            if rows:
                self.out.append(("table", 0, "\n".join(" | ".join(r) for r in rows)))
        else:
            body = "".join(self.text)
            body = body.strip("\n") if tag == "pre" else re.sub(r"\s+", " ", body).strip()
            if body:
                self.out.append(("heading" if tag in HEADINGS else "paragraph", HEADINGS.get(tag, 0), body))
        if len(self.out) > before:
            links = [(target, re.sub(r"\s+", " ", "".join(label)).strip()) for target, label in self.links]
            self.details.append((self.attrs.get("id"), (self.attrs.get("class") or "").split(), links))
        self.open, self.text, self.rows, self.links, self.in_link = None, [], [], [], False

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        if tag in HIDDEN:
            self.hidden += 1
        if self.open and self.open[0] == "table":
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                (self.rows or self.rows.append([]) or self.rows)[-1].append("")
        elif self.autoclose and self.open and self.open[0] != "table" and tag in BLOCKS:
            self.emit()
        if not self.open and not self.hidden and (tag in HEADINGS or tag in TEXTS or tag == "table"):
            self.open, self.attrs = (tag, len(self.stack)), {k: v or "" for k, v in attrs}
        elif self.open and tag == "br":
            self.text.append("\n" if self.open[0] == "pre" else " ")
        if self.open and tag == "a" and not self.hidden:
            target = dict(attrs).get("href")
            self.in_link = bool(target)
            if target:
                self.links.append((target, []))
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):  # noqa: ANN001
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag == "a":
            self.in_link = False
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
            if self.open and len(self.stack) <= self.open[1]:
                self.emit()

    def handle_data(self, data):  # noqa: ANN001
        if self.hidden or not self.open:
            return
        if self.in_link:
            self.links[-1][1].append(data)
        if self.open[0] != "table":
            self.text.append(data)
        elif self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


def html_blocks(text: str, autoclose: bool = True) -> list[Block]:
    """Headings, paragraphs and tables in document order; what a block holds is not looked into again.

    Without ``autoclose`` a paragraph that is never closed takes in all that follows it in its parent.
    """
    p = _Html(autoclose)
    p.feed(text)
    p.close()
    p.emit()
    return p.out


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.open = self.done = False

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        if self.done:
            return
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            span = [int(m[0]) if (m := re.match(r"[0-9]{1,3}", dict(attrs).get(k) or "")) else 1 for k in ("colspan", "rowspan")]
            (self.rows or self.rows.append([]) or self.rows)[-1].append(["", *span])
            self.open = True

    def handle_endtag(self, tag):  # noqa: ANN001
        self.open &= tag not in ("td", "th", "tr", "table")
        self.done |= tag == "table"

    def handle_data(self, data):  # noqa: ANN001
        if self.open and not self.done:
            self.rows[-1][-1][0] += data


def table_cells(html: str) -> list[list[tuple[str, int, int]]]:
    """Cells (text, columns, rows that it spans) of the rows of the first table; without one none."""
    p = _Cells()
    p.feed(html)
    p.close()
    return [[(re.sub(r"\s+", " ", t).strip(), c, r) for t, c, r in row] for row in p.rows]


ELEMENTS = pa.schema([("id", pa.int64()), ("pos", pa.int64()), ("type", pa.string()), ("level", pa.int64()), ("body", pa.string()), ("element_id", pa.string()), ("classes", pa.list_(pa.string())), ("links", pa.list_(pa.struct([("target", pa.string()), ("label", pa.string())])))])


def html_elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """id, pos, type, level, body of each block of a page with the id and classes of its element and the links in it (target, label).

    A null page has no blocks. A label is the text of its link, without what is hidden; links without a target are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = _Html(True)
                p.feed(text or "")
                p.close()
                p.emit()
                out += [(i, n, *block, e, c, [{"target": t, "label": x} for t, x in links]) for n, (block, (e, c, links)) in enumerate(zip(p.out, p.details, strict=True))]
            columns = zip(*out, strict=True) if out else [[]] * len(ELEMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, ELEMENTS, strict=True)], schema=ELEMENTS)

    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, pos long, type string, level long, body string, element_id string, classes array<string>, links array<struct<target: string, label: string>>")


def clean_title(text: str, most: int = 120) -> str:
    """A heading without images, links and marks, at most ``most`` characters."""
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\s+", " ", re.sub(r"[*_`]+", "", text)).strip(" #")
    return text if len(text) <= most else text[:most] + "…"


def markdown_blocks(text: str) -> list[Block]:
    """Headings, paragraphs, tables, code and block headers (``- **#id** …``, level by indentation)."""
    out: list[Block] = []
    part: list[str] = []
    fence = ""

    def flush() -> None:
        if part:
            table = len(part) > 1 and "|" in part[0] and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", part[1])
            out.append(("table" if table else "paragraph", 0, "\n".join(part)))
            part.clear()

    for line in text.split("\n"):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                out.append(("code", 0, "\n".join(part)))
                part.clear()
                fence = ""
            else:
                part.append(line)
        elif mark:
            flush()
            fence = mark[1]
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            flush()
            out.append(("heading", len(m[1]), clean_title(m[2])))
        elif m := re.match(r"(\s*)- \*\*#([\w.-]+)\*\*", line):
            flush()
            out.append(("heading", min(6, len(m[1].expandtabs(2)) // 2 + 1), m[2]))
        elif line.strip():
            part.append(line)
        else:
            flush()
    if fence:
        out.append(("code", 0, "\n".join(part)))
    else:
        flush()
    return out


def email_blocks(text: str) -> list[Block]:
    """Subject as a heading, the address headers and date (ISO), the body (text, else HTML), attachments."""
    m = email.message_from_string(text, policy=email.policy.default)
    out: list[Block] = [("heading", 1, str(m["subject"] or "(no subject)"))]
    heads = [f"{n}: {m[h]}" for n, h in (("Sender", "from"), ("Receiver", "to"), ("Cc", "cc"), ("Bcc", "bcc")) if m[h]]
    if m["date"]:
        heads.append(f"Date: {email.utils.parsedate_to_datetime(str(m['date'])).isoformat()}")
    if heads:
        out.append(("paragraph", 0, "\n".join(heads)))
    body = m.get_body(("plain", "html"))
    if body is not None:
        content = body.get_content()
        if body.get_content_type() == "text/html":
            content = "\n".join(b[2] for b in html_blocks(content))
        if content.strip():
            out.append(("paragraph", 0, content.strip()))
    names = [a.get_filename() or "unnamed" for a in m.iter_attachments()]
    return [*out, ("paragraph", 0, "Attachments: " + ", ".join(names))] if names else out


def notebook_blocks(text: str) -> list[Block]:
    """One block for each cell that is not empty; a Markdown cell that begins with a heading is one."""
    out: list[Block] = []
    for cell in json.loads(text).get("cells", []):
        source = cell.get("source", "")
        source = ("".join(source) if isinstance(source, list) else source).strip()
        if not source:
            continue
        m = re.match(r"(#{1,6})\s+(.*)", source) if cell.get("cell_type") == "markdown" else None
        out.append(("heading", len(m[1]), clean_title(m[2])) if m else ("code" if cell.get("cell_type") == "code" else "paragraph", 0, source))
    return out


PARSERS: dict[str, Callable[[str], list[Block]]] = {"html": html_blocks, "markdown": markdown_blocks, "email": email_blocks, "notebook": notebook_blocks}
#: Rows of a batch that goes back to Spark, about.
OUT = 20_000
SUFFIXES = {"html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "markdown", "eml": "email", "ipynb": "notebook"}
LEGACY = ("doc", "xls", "ppt")


def parsed(rows: DataFrame, key: str, text: str, format: str) -> DataFrame:
    """``key``, pos, type, level, body: the blocks of each row's text; a null text is empty."""
    parse = PARSERS[format]
    kind = pa.int64() if dict(rows.dtypes)[key] == "bigint" else pa.string()
    schema = pa.schema([(key, kind), ("pos", pa.int64()), ("type", pa.string()), ("level", pa.int64()), ("body", pa.string())])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = parse(t or "")
                except Exception as e:  # noqa: BLE001  one bad file is a row, not a failed job
                    found = [("error", 0, f"{type(e).__name__}: {e}")]
                out += [(k, i, *x) for i, x in enumerate(found)]
                if len(out) >= OUT:
                    yield batch(out)
                    out = []
            yield batch(out)

    return rows.select(F.col(key).cast("long" if kind == pa.int64() else "string").alias(key), F.col(text).cast("string")).mapInArrow(run, f"{key} {'long' if kind == pa.int64() else 'string'}, pos long, type string, level long, body string")


def format_of(path: Column) -> Column:
    """Format by a path's suffix; an error code for legacy, macro and unknown files."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(suffix.isin(*LEGACY), "error:legacy_format").when(suffix.rlike("^(docm|xlsm|pptm)$"), "error:macro_format")
    for s, f in SUFFIXES.items():
        out = out.when(suffix == s, f)
    return out.otherwise("error:unsupported_format")


def decoded(content: Column) -> Column:
    """Text of bytes by the first encoding that reads all of them, from UTF-8 to single bytes; null if none."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            for e in ("utf-8-sig", "utf-8", "cp950", "big5", "gb18030", "cp1252"):
                try:
                    return None if b is None else bytes(b).decode(e)
                except UnicodeDecodeError:
                    continue
            return None

        return s.map(one)

    return run(content)
