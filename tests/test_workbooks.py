"""Workbook rows in batches: the two ways of reading a sheet agree, and values of all kinds are written as text."""

import datetime
import io
import zipfile

import pyarrow as pa
import pytest

from interlace.sources import xlsx as X

ODD = ["a", None, "", " <&> \"' ", "x\r\ny\t\u0001", "_x0041_", "ünï 🎯", "_x_", "&amp;", "&#65;", "]]>", "7"]
ROWS = [(ODD[i % len(ODD)], str(i), ODD[i // len(ODD) % len(ODD)]) for i in range(300)]


def sheet_of(rows) -> bytes:
    file = io.BytesIO()
    file.close = lambda: None
    book = X.Book(file, ["a", "b", "c"])
    columns = [X.marked(pa.array(c, pa.large_string())) for c in zip(*rows)]
    book.put("S", columns, len(rows))
    book.close()
    return zipfile.ZipFile(io.BytesIO(file.getvalue())).read("xl/worksheets/sheet1.xml")


def read(sheet: bytes, size: int, width: int = 3) -> tuple[list, bool]:
    rows = X.Rows(width, 2, [])
    for at in range(0, len(sheet), size):
        rows.feed(sheet[at : at + size])
    plain = rows.plain
    rows.feed(b"", True)
    cells, numbers = rows.taken()
    assert numbers == list(range(2, len(numbers) + 2))
    return [tuple(c) for c in cells], plain


@pytest.mark.parametrize("size", [1, 7, 1000, 1 << 20])
def test_rows_of_the_sink_are_read_without_a_parser(size):
    """Each element of each cell was an event for Python, some 80 microseconds a row."""
    assert read(sheet_of(ROWS), size) == (ROWS, True)


@pytest.mark.parametrize("size", [1, 1000, 1 << 20])
@pytest.mark.parametrize("old, new", [
    (b"<worksheet ", b"<?xml version='1.0'?>\n<worksheet "),
    (b'<row r="150">', b'<row r="150" spans="1:3">'),
    (b'<row r="150">', b"<!-- <row r='9'/> --><row>"),
    (b'<c r="B150" t="inlineStr"><is><t xml:space="preserve">148</t></is>', b'<c t="inlineStr" r="B150"><is><r><t>1</t></r><r><t>&#52;8</t></r></is>'),
    (b'<c r="B150" t="inlineStr"><is><t xml:space="preserve">148</t></is></c>', b'<c r="B150"><f>1+1</f><v>148</v></c>'),
])
def test_other_forms_go_to_the_parser(size, old, new):
    sheet = sheet_of(ROWS)
    assert sheet.count(old) == 1
    assert read(sheet.replace(old, new), size) == (ROWS, False)


def test_narrow_and_broken_sheets():
    sheet = sheet_of(ROWS)
    assert read(sheet, 1000, 2)[0] == [r[:2] for r in ROWS]
    assert read(sheet, 1000, 4)[0] == [(*r, None) for r in ROWS]
    for broken in (sheet[:-20], sheet.replace(b"</row>", b"</c>", 1), sheet.replace(b"148", b"&none;", 1), sheet.replace(b"148", b"\x01", 1), sheet.replace(b"148", b"\xff", 1)):
        with pytest.raises((X.expat.ExpatError, UnicodeDecodeError)):
            read(broken, 1000)


def test_values_are_text(spark, tmp_path):
    spark.dataSource.register(X.XlsxDataSource)
    values = "1L AS a, 2.50D AS b, 3.10BD AS c, true AS d, DATE'2024-01-02' AS e, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS f, CAST(NULL AS INT) AS g, TIMESTAMP'2024-01-02 03:04:05.5' AS h"
    spark.sql(f"SELECT 'S' AS sheet_name, {values}").write.format("xlsx").mode("append").save(str(tmp_path / "b"))
    got = spark.read.format("xlsx").option("columns", 8).load(str(tmp_path / "b")).first()
    local = datetime.datetime(2024, 1, 2, 3, 4, 5, 500000, datetime.timezone.utc).astimezone().replace(tzinfo=None)
    assert tuple(got)[2:] == ("1", "2.5", "3.10", "True", "2024-01-02", "2024-01-02 03:04:05", None, str(local))
