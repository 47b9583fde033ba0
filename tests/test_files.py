"""Folder scan, parsers and page documents."""

import io
import re
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions.text import html_text
from ledgerleaf.operators import metrics, pages
from ledgerleaf.sources import files, parsers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return data.getvalue()


def docx():
    def cell(value):
        return f"<w:tc><w:p><w:r><w:t>{value}</w:t></w:r></w:p></w:tc>"

    rows = [("Metric", "Q1 2024"), ("Revenue", "$5M")]
    table = "".join("<w:tr>" + "".join(cell(v) for v in row) + "</w:tr>" for row in rows)
    body = (
        "<w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>paragraph</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Second</w:t></w:r></w:p>"
        f"<w:tbl>{table}</w:tbl><w:sectPr/>"
    )
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx():
    sheet = (
        f'<worksheet {S}><sheetData>'
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>FY24</t></is></c></row>'
        '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>1200</v></c><c r="D2"><v>7.5</v></c></row>'
        "</sheetData></worksheet>"
    )
    return packed(
        {
            "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="P&amp;L" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {S}><si><t>Metric</t></si><si><t>Q1 2024</t></si><si><r><t>Net </t></r><r><t>income</t></r></si></sst>",
            "xl/worksheets/sheet1.xml": sheet,
        }
    )


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    root = tmp_path_factory.mktemp("base")
    contents = {
        "acme/financials/q1.CSV": b"Metric,Q1 2024,Q2 2024\nTotal Revenue,$5M,$6M\nNotes,a,\n",
        "acme/readme.md": "# Title\nRevenue: $5M\n".encode(),
        "acme/broken.txt": b"ok\xff\xfe bytes\n",
        "acme/memo.docx": docx(),
        "beta/book.xlsx": xlsx(),
        "beta/bad.docx": b"no zip",
        "beta/deck.pptx": b"x",
        "beta/image.png": b"x",
        "stray.txt": b"outside",
    }
    for name, content in contents.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return str(root)


def test_scan(spark, base):
    rows = files.scan_files(spark, base).drop("content").collect()
    assert {row["relative_path"] for row in rows} == {
        "acme/financials/q1.CSV", "acme/readme.md", "acme/broken.txt", "acme/memo.docx", "beta/book.xlsx", "beta/bad.docx",
        "beta/deck.pptx", "stray.txt",
    }
    assert {row["file_type"] for row in rows} == {".csv", ".md", ".txt", ".docx", ".xlsx", ".pptx"}
    assert [r["filename"] for r in files.scan_files(spark, base, recursive=False).collect()] == ["stray.txt"]
    assert files.scan_files(spark, base + "/none").count() == 0
    assert files.scan_files(spark, base, max_bytes=1).count() == 1


def test_companies_and_manifest(spark, base):
    found = files.company_files(spark, base)
    assert {row[0] for row in found.select("company_folder").collect()} == {"acme", "beta"}
    listed = files.manifest(found, "company_folder").collect()
    hashed = files.manifest(found, "company_folder", hash_content=True).collect()
    assert len({row["document_id"] for row in listed}) == len(listed) == 7
    assert len({row["document_id"] for row in hashed}) == 7
    assert {"financials/q1.CSV", "readme.md"} <= {row["relative_path"] for row in listed}
    plan = files.manifest(found, "company_folder")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


@pytest.fixture(scope="module")
def extracted(spark, base):
    found = files.scan_files(spark, base).withColumn("document_id", F.col("relative_path"))
    return {row["document_id"]: row for row in parsers.extract(found).collect()}


def test_text(extracted):
    assert extracted["acme/readme.md"]["full_text"] == "# Title\nRevenue: $5M\n"
    assert extracted["acme/readme.md"]["line_count"] == 3
    assert extracted["acme/broken.txt"]["full_text"] == "ok bytes\n"


def test_paragraphs_of_a_large_text_are_no_copies():
    content = b"Some words of a paragraph\n \t\n" * 100_000 + b"\n\n \n"
    tracemalloc.start()
    parsed = parsers.parse_text(content)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parsed["paragraph_count"] == 100_000
    assert peak < 1.2 * len(content)


@pytest.mark.parametrize("text", ["", "\n", " \n\n\t", "a", "a\n\nb", "\n\na\n \n\n\nb \n", "a\n\x0b\nb\n\n\x0b", "a\n\n\n\nb\n\n "])
def test_paragraph_count(text):
    parts = re.split(r"\n[ \t]*\n", text)
    assert parsers.parse_text(text.encode())["paragraph_count"] == sum(bool(part.strip(" \t\n")) for part in parts)


def test_csv(extracted):
    row = extracted["acme/financials/q1.CSV"]
    assert (row["row_count"], row["col_count"], row["page_count"], row["has_tables"]) == (2, 3, 1, True)
    assert row["cells"][1].asDict() == {
        "table_index": 0, "table_name": None, "row_index": 0, "col_index": 1, "row_label": "Total Revenue",
        "col_name": "Q1 2024", "value": "$5M",
    }


def test_word(extracted):
    row = extracted["acme/memo.docx"]
    assert row["full_text"] == "First paragraph\n\nSecond"
    assert (row["paragraph_count"], row["table_count"], row["page_count"], row["has_charts"]) == (2, 1, 1, False)


def test_workbook(extracted):
    row = extracted["beta/book.xlsx"]
    assert row["full_text"].startswith("Sheet: P&L\nMetric | Q1 2024")
    assert (row["sheet_count"], row["total_rows"], row["page_count"]) == (1, 1, 1)
    assert {(c["col_name"], c["value"]) for c in row["cells"]} >= {("Q1 2024", "1200"), ("FY24", "7.5")}


def test_failures_are_rows(extracted):
    assert extracted["beta/deck.pptx"]["error"] == "Unsupported file type: .pptx"
    assert extracted["beta/bad.docx"]["success"] is False
    assert extracted["beta/bad.docx"]["error"]


def test_other_parser(spark, base):
    found = files.scan_files(spark, base).withColumn("document_id", F.col("relative_path"))
    deck = parsers.extract(found, {".pptx": lambda data: {"full_text": f"{len(data)} bytes", "page_count": 1}})
    assert deck.filter("document_id = 'beta/deck.pptx'").first()["full_text"] == "1 bytes"


def test_cells_give_metrics(spark, base):
    found = files.scan_files(spark, base).withColumn("document_id", F.col("relative_path"))
    cells = parsers.extracted_cells(parsers.extract(found)).withColumn("company_id", F.lit("c"))
    rows = metrics.table_metrics(cells).select("document_id", "period", "metric_name", "value").collect()
    assert {tuple(row) for row in rows} == {
        ("acme/financials/q1.CSV", "Q1 2024", "revenue", 5e6), ("acme/financials/q1.CSV", "Q2 2024", "revenue", 6e6),
        ("acme/memo.docx", "Q1 2024", "revenue", 5e6), ("beta/book.xlsx", "Q1 2024", "net_income", 1200.0),
        ("beta/book.xlsx", "FY24", "net_income", 7.5),
    }
    larger = metrics.table_metrics(cells, min_rows=3).select("document_id").distinct().collect()
    assert [row[0] for row in larger] == ["acme/financials/q1.CSV"]


def test_grid_cells(spark):
    grid = [("d", 0, r, c, v) for r, line in enumerate([["", "Q1 2024"], ["Sales", "3K"]]) for c, v in enumerate(line)]
    frame = spark.createDataFrame(grid, "document_id string, table_index int, row_index int, col_index int, value string")
    row = metrics.grid_cells(frame).filter("col_index = 1").first()
    assert (row["row_label"], row["col_name"], row["value"]) == ("Sales", "Q1 2024", "3K")


def test_urls(spark, tmp_path):
    (tmp_path / "urls.txt").write_text(" https://a.com/x.pdf \n\n\nhttps://b.com\n")
    assert [row["url"] for row in files.read_urls(spark, str(tmp_path / "urls.txt")).collect()] == [
        "https://a.com/x.pdf", "https://b.com",
    ]


def test_read_texts(spark, base):
    rows = {row["path"].rsplit("/", 1)[1]: row for row in files.read_texts(spark, base + "/acme").collect()}
    assert rows["broken.txt"]["text"] == "ok bytes\n"
    assert rows["readme.md"]["line_count"] == 3


def test_pages_in_blocks(spark):
    texts = [f"p{i}" * (i % 5) for i in range(1, 41)]
    frame = spark.createDataFrame([("d", i + 1, t, i % 2) for i, t in enumerate(texts)], "document_id string, page int, text string, n_images int")
    row = pages.page_documents(frame.orderBy(F.rand(3)), pages_per_block=7).first()
    starts, at = [], 0
    for t in texts:
        starts.append(at)
        at += len(t) + 2
    assert row["full_text"] == "\n\n".join(texts)
    assert row["page_starts"] == starts
    assert (row["page_count"], row["has_charts"]) == (40, True)
    assert pages.page_counts(frame).first()["char_count"] == len(row["full_text"])


def test_payloads_are_parsed_by_media_type(spark):
    page = "<!DOCTYPE html><html><head><meta charset='latin-1'><title>T</title><style>p{}</style></head><body><p>Größe &amp; mehr</p><!-- x --></body></html>"
    rows = [
        ("http://a.org/x", page.encode("latin-1"), None),
        ("http://a.org/y.pdf", b"  <html><body>web &lt;page&gt;</body></html>", "application/octet-stream"),
        ("http://a.org/z", b"a,b\n1,2\n", "Text/CSV; charset=utf-8"),
        ("http://a.org/n.txt", b"plain words", None),
        ("http://a.org/p", b"%PDF-1.7 ...", None),
        ("http://a.org/gone", None, "text/html"),
    ]
    fetched = spark.createDataFrame(rows, "url string, content binary, kind string").withColumn("company", F.lit("c"))
    found = files.payload_files(fetched, "company", declared="kind", with_content=True)
    assert "kind" not in found.columns
    pages = {"p": lambda content: {"pages": ["one", "two"], "has_charts": True}}
    read = parsers.extract(found.select("document_id", "file_type", "content", "source_url"), {".pdf": pages["p"]}, keep=("source_url",))
    texts = {r.source_url.rsplit("/", 1)[1]: r for r in read.collect()}
    assert texts["x"].full_text == "T Größe & mehr" and texts["x"].file_type == "html"
    assert texts["y.pdf"].full_text == "web <page>"
    assert texts["z"].full_text == "a | b\n1 | 2"
    assert texts["n.txt"].full_text == "plain words"
    assert (texts["p"].full_text, texts["p"].page_starts, texts["p"].page_count, texts["p"].has_charts) == ("one\n\ntwo", [0, 5], 2, True)
    assert len(texts) == 5


def test_html_parser_equals_the_column(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in pages.select("html", html_text("html").alias("text")).collect():
        assert parsers.parse_html(row.html.encode())["full_text"] == row.text
