"""Small file parsers used inside tasks: bytes of one file to text, counts and cells.

A parser takes bytes and returns a dict with the columns of ``schemas.EXTRACTED`` that it knows; in place of
``full_text`` it may give ``pages``, a list of texts. The registry maps extensions to parsers and is an argument of
``extract``, so other formats can be added.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf import schemas
from ledgerleaf.functions.text import BLANKS, ENTITIES, MARKUP
from ledgerleaf.operators.pages import PAGE_BREAK

Parser = Callable[[bytes], dict]

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _grid(rows: list[list[str | None]], index: int, name: str | None) -> list[dict]:
    """Cells of a table whose first row heads its columns; ``row_index`` counts the rows below it."""
    if not rows:
        return []
    heads = rows[0]
    return [
        {
            "table_index": index,
            "table_name": name,
            "row_index": r,
            "col_index": c,
            "row_label": row[0] if row else None,
            "col_name": heads[c] if c < len(heads) else None,
            "value": value,
        }
        for r, row in enumerate(rows[1:])
        for c, value in enumerate(row)
    ]


def _rendered(rows: list[list[str | None]]) -> str:
    return "\n".join(" | ".join("" if value is None else value for value in row) for row in rows)


_BREAK = re.compile(r"\n[ \t]*\n")
_INK = re.compile(r"[^ \t\n]")


def _paragraphs(text: str) -> int:
    """Number of parts between blank lines that are not blank, counted where they lie."""
    count = at = 0
    for gap in _BREAK.finditer(text):
        count += _INK.search(text, at, gap.start()) is not None
        at = gap.end()
    return count + (_INK.search(text, at) is not None)


def parse_text(content: bytes) -> dict:
    text = content.decode("utf-8", errors="ignore")
    return {
        "file_type": "text",
        "full_text": text,
        "page_count": 1,
        "line_count": text.count("\n") + 1,
        "paragraph_count": _paragraphs(text),
    }


_CHARSET = re.compile(rb"""<meta[^>]{0,200}charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.IGNORECASE)
_MARKUP = [re.compile(pattern, re.ASCII) for pattern in MARKUP]


def parse_html(content: bytes) -> dict:
    """Visible text of a web page, as ``html_text`` gives it, in the character set that the page declares."""
    declared = _CHARSET.search(content[:4096])
    try:
        text = content.decode(declared.group(1).decode() if declared else "utf-8", errors="ignore")
    except LookupError:
        text = content.decode("utf-8", errors="ignore")
    for pattern in _MARKUP:
        text = pattern.sub(" ", text)
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return {"file_type": "html", "full_text": re.sub(BLANKS, " ", text).strip(" "), "page_count": 1}


def parse_csv(content: bytes) -> dict:
    rows = [row for row in csv.reader(io.StringIO(content.decode("utf-8-sig", errors="ignore"))) if row]
    if not rows:
        raise ValueError("No columns to parse from file")
    cells = [[value or None for value in row] for row in rows]
    return {
        "file_type": "csv",
        "full_text": _rendered(cells),
        "page_count": 1,
        "has_tables": True,
        "table_count": 1,
        "row_count": len(rows) - 1,
        "col_count": len(rows[0]),
        "cells": _grid(cells, 0, None),
    }


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def parse_docx(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = _xml(archive, "word/document.xml").find(f"{_WORD}body")

    def text_of(node: ElementTree.Element) -> str:
        marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n"}
        return "".join(
            (part.text or "") if part.tag == f"{_WORD}t" else marks.get(part.tag, "") for part in node.iter()
        )

    paragraphs = [text for text in (text_of(p) for p in body.findall(f"{_WORD}p")) if text.strip()]
    tables = [
        [
            ["\n".join(text_of(p) for p in cell.findall(f"{_WORD}p")) for cell in row.findall(f"{_WORD}tc")]
            for row in table.findall(f"{_WORD}tr")
        ]
        for table in body.findall(f"{_WORD}tbl")
    ]
    return {
        "file_type": "word",
        "full_text": "\n\n".join(paragraphs),
        "page_count": len(list(body.iter(f"{_WORD}sectPr"))),
        "has_tables": bool(tables),
        "table_count": len(tables),
        "paragraph_count": len(paragraphs),
        "cells": [cell for i, rows in enumerate(tables) for cell in _grid(rows, i, None)],
    }


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _sheet_rows(sheet: ElementTree.Element, shared: list[str]) -> list[list[str | None]]:
    rows = []
    for row in sheet.iter(f"{_SHEET}row"):
        values: list[str | None] = []
        for cell in row.findall(f"{_SHEET}c"):
            column = _column_number(cell.get("r", "")) if cell.get("r") else len(values)
            values.extend([None] * (column - len(values)))
            kind, value = cell.get("t"), cell.find(f"{_SHEET}v")
            if kind == "inlineStr":
                values.append("".join(t.text or "" for t in cell.iter(f"{_SHEET}t")))
            elif value is None:
                values.append(None)
            else:
                values.append(shared[int(value.text)] if kind == "s" else value.text)
        if any(value is not None for value in values):
            rows.append(values)
    return rows


def parse_xlsx(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = [
                "".join(t.text or "" for t in item.iter(f"{_SHEET}t"))
                for item in _xml(archive, "xl/sharedStrings.xml").findall(f"{_SHEET}si")
            ]
        targets = {link.get("Id"): link.get("Target") for link in _xml(archive, "xl/_rels/workbook.xml.rels")}
        sheets = []
        for sheet in _xml(archive, "xl/workbook.xml").iter(f"{_SHEET}sheet"):
            target = targets[sheet.get(_LINK)]
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            sheets.append((sheet.get("name"), _sheet_rows(_xml(archive, name), shared)))
    return {
        "file_type": "excel",
        "full_text": "\n\n".join(f"Sheet: {name}\n{_rendered(rows)}" for name, rows in sheets),
        "page_count": len(sheets),
        "has_tables": True,
        "table_count": len(sheets),
        "sheet_count": len(sheets),
        "total_rows": sum(max(len(rows) - 1, 0) for _, rows in sheets),
        "cells": [cell for i, (name, rows) in enumerate(sheets) for cell in _grid(rows, i, name)],
    }


def _no_decoder(kind: str) -> Parser:
    def parse(content: bytes) -> dict:
        raise ValueError(f"No {kind} decoder registered")

    return parse


# Formats without a decoder here are known types all the same: they give an error row until one is passed in.
PARSERS: dict[str, Parser] = {
    ".pdf": _no_decoder(".pdf"),
    ".docx": parse_docx,
    ".doc": _no_decoder(".doc"),
    ".xlsx": parse_xlsx,
    ".xls": _no_decoder(".xls"),
    ".csv": parse_csv,
    ".txt": parse_text,
    ".md": parse_text,
    ".html": parse_html,
    ".htm": parse_html,
}

_COLUMNS = list(schemas.EXTRACTED_FIELDS)
_CELL = pa.struct([(name, pa.int32() if name.endswith("_index") else pa.string()) for name in re.findall(r"(\w+):", schemas.CELL)])
_KINDS = {"STRING": pa.string(), "BOOLEAN": pa.bool_(), "INT": pa.int32(), "ARRAY<INT>": pa.list_(pa.int32()), f"ARRAY<{schemas.CELL}>": pa.list_(_CELL)}
# Parsed files that leave a task together: their number, and their size in characters, cells counted as some.
FRAME_FILES, FRAME_SIZE, _CELL_SIZE = 1000, 2_000_000, 100
_DEFAULTS = {"has_tables": False, "has_charts": False, "table_count": 0}


def _joined(parsed: dict) -> dict:
    """Pages become one text, with the offset at which each begins."""
    if "pages" not in parsed:
        return parsed
    texts = parsed.pop("pages")
    starts, at = [], 0
    for text in texts:
        starts.append(at)
        at += len(text) + len(PAGE_BREAK)
    return {"page_count": len(texts), "page_starts": starts, "full_text": PAGE_BREAK.join(texts)} | parsed


def extract(
    files: DataFrame,
    parsers: dict[str, Parser] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Text, counts and cells of files (``schemas.EXTRACTED``), one row per file.

    ``files`` has ``document_id, file_type, content``. String columns in ``keep`` are passed on, which saves
    joining texts with them later. A file that cannot be parsed becomes a row with ``success = false`` and
    its ``error``.
    """
    registry = PARSERS if parsers is None else {**PARSERS, **parsers}
    names = [*keep, *_COLUMNS]

    def parse_one(key: str, extension: str, data: bytes) -> dict:
        row = dict.fromkeys(_COLUMNS) | {"document_id": key, "success": False}
        if extension not in registry:
            return row | {"error": f"Unsupported file type: {extension}"}
        try:
            parsed = _joined(registry[extension](bytes(data)))
        except Exception as error:  # one bad file must not fail the job
            return row | {"error": str(error) or type(error).__name__}
        return row | _DEFAULTS | parsed | {"success": True, "char_count": len(parsed["full_text"])}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {name: "Int32" for name in _COLUMNS if name.endswith("_count") or name == "total_rows"}
        kinds = [pa.string()] * len(keep) + [_KINDS[kind] for kind in schemas.EXTRACTED_FIELDS.values()]
        held: list[dict] = []

        def parsed(batch: pa.RecordBatch, r: int) -> dict:
            key, extension, *kept = (batch.column(i)[r].as_py() for i in (0, 1, *range(3, batch.num_columns)))
            return dict(zip(keep, kept, strict=True)) | parse_one(key, extension, batch.column(2)[r].as_py())

        def made() -> pa.RecordBatch:
            # Texts change places with their bytes one by one, so that a large one is there twice and no more.
            texts = [row.pop("full_text") for row in held]
            for i in range(len(texts)):
                if isinstance(texts[i], str):
                    texts[i] = texts[i].encode()
            frame = pd.DataFrame(held, columns=names).astype(counts)
            held.clear()
            full = pa.array(texts, pa.binary()).cast(pa.string())
            columns = (frame.iloc[:, i] for i in range(len(names)))
            return pa.RecordBatch.from_arrays(
                [full if name == "full_text" and i >= len(keep) else pa.Array.from_pandas(column, type=kind) for i, (name, column, kind) in enumerate(zip(names, columns, kinds, strict=True))],
                names,
            )

        # Small files share a frame; a large one is parsed and handed on by itself. Of large files the bytes and the text of
        # one are held at a time, beside the batch they came in.
        size = 0
        for batch in batches:
            for r in range(batch.num_rows):
                held.append(parsed(batch, r))
                size += len(held[-1]["full_text"] or "") + _CELL_SIZE * len(held[-1]["cells"] or ())
                if size >= FRAME_SIZE or len(held) >= FRAME_FILES:
                    yield made()
                    size = 0
        if held:
            yield made()

    passed = "".join(f"`{name}` STRING, " for name in keep)
    return files.select("document_id", F.lower("file_type").alias("_type"), "content", *keep).mapInArrow(
        parse, passed + schemas.EXTRACTED
    )


def extracted_cells(extracted: DataFrame) -> DataFrame:
    """Cells of all tables in long form."""
    kept = [name for name in extracted.columns if name in ("company_id", "document_type")]
    return extracted.filter("success").select("document_id", *kept, F.inline("cells"))
