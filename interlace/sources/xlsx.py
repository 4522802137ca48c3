"""Workbooks as a Spark source and sink: one task for each sheet, rows as strings, with the standard library.

    spark.dataSource.register(XlsxDataSource)
    spark.read.format("xlsx").option("columns", 16).load("workbook.xlsx")
    df.write.format("xlsx").mode("append").save("folder")     # a column sheet_name, and any others as cells

Read: columns sheet_name, row_number, c1..cN of a workbook, or of all workbooks in a folder. A missing cell is null; rows
before `first_row` are left out. Workbooks are small by their format (a million rows in a sheet), so a sheet is one task;
executors read the file from its path, on any store that Arrow's file systems reach.

Written: a folder of workbooks. A task writes its rows as they come and begins another workbook when one is full
(`rows` rows) or a sheet comes back, so rows sorted by sheet_name make the fewest. A workbook gets its name when the whole
job has succeeded; those of failed or repeated tasks are deleted. Numbers, times and truth values are written as text.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from datetime import datetime
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Rows of one written workbook; the format allows 1,048,576 in a sheet.
ROWS = 250_000
#: Rows that are put together or handed to Spark at once, bytes of their values, bytes of a sheet that are read at once, and of a row that is cut by a pattern.
BATCH, BATCH_BYTES, CHUNK, MOST_ROW = 2000, 4 << 20, 1 << 18, 1 << 21

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_index(reference: str) -> int:
    """Zero-based column of a cell reference such as 'AB12'."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheets_of(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names and the members that hold them."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")
    return {s.get("name"): "xl/" + links[s.get(_REL)].lstrip("/").removeprefix("xl/") for s in found}


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]


#: Signs that XML can't hold or would change, and texts that look like their escapes.
_ODD = re.compile("[\x00-\x08\x0b-\x1f\ud800-\udfff\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def escaped(text: str) -> str:
    """The text with such signs as _xHHHH_, the format's own escape."""
    return escape(_ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


#: Whether a text has a sign to escape, in the terms of Arrow's expressions.
_MARKED = r"[&<>\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]|_x[0-9A-Fa-f]{4}_"


def marked(texts: pa.Array) -> pa.Array:
    """The texts, escaped; few have anything to escape, and only those go one by one."""
    odd = pc.match_substring_regex(texts, _MARKED)
    if not pc.any(odd).as_py():
        return texts
    return pc.replace_with_mask(texts, pc.fill_null(odd, False), pa.array([escaped(t) for t in texts.filter(odd).to_pylist()], texts.type))


def written_text(column: pa.Array) -> pa.Array:
    """The values as text, as Python writes them; times of a zone as local ones."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_integer(column.type)):
        values = (v.astimezone().replace(tzinfo=None) if isinstance(v, datetime) and v.tzinfo else v for v in column.to_pylist())
        column = pa.array([None if v is None else str(v) for v in values], pa.large_string())
    return column.cast(pa.large_string())


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of BATCH rows and some BATCH_BYTES at most."""
    for batch in batches:
        rows = min(BATCH, max(1, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unescaped(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def column_name(index: int) -> str:
    """The letters of a zero-based column, such as 'AB' for 27."""
    name, n = "", index + 1
    while n:
        n, letter = divmod(n - 1, 26)
        name = chr(65 + letter) + name
    return name


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it; Spark writes local addresses as file:/x too."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


class Sheet(InputPartition):
    def __init__(self, path: str, name: str, member: str) -> None:
        self.path, self.name, self.member = path, name, member


#: A sheet's begin as the sink writes it, and the text of a cell with what may be escaped in it.
_HEAD = f'<worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode()
_PLAIN = r"[^<>&\x00-\x08\x0b-\x1f]*"
_TEXT = f"{_PLAIN}(?:&(?:amp|lt|gt);{_PLAIN})*"


def plain_row(width: int) -> re.Pattern:
    """A row of at most so many cells as the sink writes it: its number and the cells' texts."""
    cells = (f'(?:<c r="{column_name(i)}[0-9]+" t="inlineStr"><is><t xml:space="preserve">({_TEXT})</t></is></c>)?' for i in range(width))
    return re.compile(f'<row r="([0-9]+)">{"".join(cells)}</row>')


def plain_text(text: str | None) -> str | None:
    if text is not None and "&" in text:
        text = text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
    return text and unescaped(text)


class Rows:
    """The rows of a sheet from its bytes. Rows in the very form that the sink writes are cut by a pattern; the first other one and
    all that follows go to an XML parser, which sees the sheet without the rows that were cut."""

    def __init__(self, width: int, first: int, strings: list[str]) -> None:
        self.cells: list[list[str | None]] = []
        self.numbers: list[int] = []
        self.first, self.row = first, plain_row(width)
        self.plain, self.begun, self.rest = True, False, b""
        self.number = 0
        names = row_tag, cell_tag, text_tag, value_tag = [f"{_NS[1:]}{n}" for n in ("row", "c", "t", "v")]
        # Names that the parser knows are one object each, so comparing them is cheap.
        self.parser = parser = expat.ParserCreate(None, "}", intern={n: n for n in names})
        parser.buffer_text, parser.buffer_size = True, 1 << 16
        places: dict[str, int] = {}
        place, at, kind, cells = -1, 0, None, None
        texts: list[str] = []  # of the open cell
        value: str | None = None
        chars: list[str] = []  # of the open text or value

        def start(tag: str, attributes: dict[str, str]) -> None:
            nonlocal place, at, kind, cells, value
            if tag == text_tag or tag == value_tag:
                chars.clear()
            elif tag == cell_tag and cells is not None:
                place, kind, value = place + 1, attributes.get("t"), None
                texts.clear()
                at = place
                if reference := attributes.get("r"):
                    letters = reference.rstrip("0123456789")
                    if (known := places.get(letters)) is None:
                        known = places[letters] = column_index(letters)
                    at = known
            elif tag == row_tag:
                self.number, place, cells = int(attributes.get("r", self.number + 1)), -1, [None] * width

        def end(tag: str) -> None:
            nonlocal cells, value
            if tag == text_tag:
                texts.append("".join(chars))
            elif tag == cell_tag and cells is not None:
                if at < width:
                    if kind == "inlineStr":
                        cells[at] = unescaped("".join(texts))
                    else:
                        cells[at] = unescaped(strings[int(value)]) if kind == "s" and value is not None else value
            elif tag == value_tag:
                value = "".join(chars) if value is None else value
            elif tag == row_tag:
                if self.number >= first:
                    self.cells.append(cells)
                    self.numbers.append(self.number)
                cells = None

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars.append

    def feed(self, chunk: bytes, last: bool = False) -> None:
        data = self.rest + chunk
        if self.plain and not self.begun and (last or len(data) >= len(_HEAD)):
            self.plain = self.begun = data.startswith(_HEAD)
            if self.begun:
                self.parser.Parse(_HEAD, False)
                data = data[len(_HEAD) :]
        if self.plain and self.begun:
            data = self.cut(data)
        if self.plain and not last:
            self.rest = data
        else:
            self.rest = b""
            self.parser.Parse(data, last)

    def cut(self, data: bytes) -> bytes:
        """Take the whole rows at the begin of the data; what is left of it."""
        end = data.rfind(b"</row>")
        if end < 0:
            self.plain = len(data) < MOST_ROW
            return data
        text, at = data[: end + 6].decode(), 0
        odd = "&" in text or "_x" in text
        for found in iter(self.row.scanner(text).match, None):
            number, *cells = found.groups()
            at, self.number = found.end(), int(number)
            if self.number >= self.first:
                self.cells.append([plain_text(c) for c in cells] if odd else cells)
                self.numbers.append(self.number)
        self.plain = at == len(text)
        return data[end + 6 :] if self.plain else text[at:].encode() + data[end + 6 :]

    def taken(self) -> tuple[list[list[str | None]], list[int]]:
        """The rows so far and their numbers, which are not held any longer."""
        found = self.cells, self.numbers
        self.cells, self.numbers = [], []
        return found


class XlsxReader(DataSourceReader):
    def __init__(self, options, names: list[str]) -> None:
        self.names = names
        self.path, self.width, self.first = options["path"], int(options.get("columns", 16)), int(options.get("first_row", 2))
        self.sheet = options.get("sheet")

    def partitions(self) -> list[Sheet]:
        store, path = located(self.path)
        books = [path]
        if store.get_file_info(path).type == fs.FileType.Directory:
            books = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.endswith(".xlsx") and f.base_name[0] not in "._")
        found = []
        for at in books:
            with store.open_input_file(at) as file, zipfile.ZipFile(file) as book:
                found += [Sheet(at, n, m) for n, m in sheets_of(book).items() if self.sheet in (None, n)]
        return found

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        with store.open_input_file(partition.path) as file, zipfile.ZipFile(file) as book:
            rows = Rows(self.width, self.first, shared_strings(book))
            with book.open(partition.member) as member:
                while chunk := member.read(CHUNK):
                    rows.feed(chunk)
                    if len(rows.cells) >= BATCH:
                        yield self.batch(partition.name, rows)
            rows.feed(b"", True)
            yield self.batch(partition.name, rows)

    def batch(self, sheet: str, rows: Rows) -> pa.RecordBatch:
        cells, numbers = rows.taken()
        columns = zip(*cells) if cells else [()] * self.width
        return pa.RecordBatch.from_arrays([pa.array([sheet] * len(numbers), pa.string()), pa.array(numbers, pa.int64()), *(pa.array(c, pa.string()) for c in columns)], self.names)


class Book:
    """A workbook that is written row by row to a file; each sheet has the names of the columns in its first row."""

    _MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    _OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    _PACKAGE = "http://schemas.openxmlformats.org/package/2006"
    _KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"

    def __init__(self, file, columns: list[str]) -> None:
        self.file, self.columns = file, columns
        self.letters = [column_name(i) for i in range(len(columns))]
        self.zip = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
        self.sheets: list[str] = []
        self.member, self.at, self.rows = None, 0, 0

    def write(self, columns: list[pa.Array], rows: int) -> None:
        """Rows given as columns of text, put together column by column."""
        at = pa.array(range(self.at + 1, self.at + rows + 1)).cast(pa.large_string())
        self.at += rows
        # A cell without a value is null, and nothing is written for it.
        joined = lambda *parts, **options: pc.binary_join_element_wise(*(pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in (*parts, "")), **options)
        cells = [joined(f'<c r="{a}', at, '" t="inlineStr"><is><t xml:space="preserve">', c, "</t></is></c>") for a, c in zip(self.letters, columns)]
        lines = joined('<row r="', at, '">', *cells, "</row>", null_handling="replace", null_replacement="")
        whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, rows], pa.int64()), lines), pa.scalar("", pa.large_string()))
        self.member.write(whole[0].as_buffer())

    def open_sheet(self, name: str) -> None:
        if not 0 < len(name) <= 31 or re.search(r"[\[\]:*?/\\]", name):
            raise ValueError(f"{name!r} can't name a sheet")
        self.close_sheet()
        self.sheets.append(name)
        self.member, self.at = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True), 0
        self.member.write(f"<worksheet {self._MAIN}><sheetData>".encode())
        self.write([marked(pa.array([c], pa.large_string())) for c in self.columns], 1)

    def close_sheet(self) -> None:
        if self.member is not None:
            self.member.write(b"</sheetData></worksheet>")
            self.member.close()
            self.member = None

    def put(self, sheet: str, columns: list[pa.Array], rows: int) -> None:
        if not self.sheets or self.sheets[-1] != sheet:
            self.open_sheet(sheet)
        self.write(columns, rows)
        self.rows += rows

    def close(self) -> None:
        self.close_sheet()
        numbers = range(1, len(self.sheets) + 1)
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, self.sheets))
        links = "".join(f'<Relationship Id="rId{i}" Type="{self._OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{self._KIND}.worksheet+xml"/>' for i in numbers)
        self.zip.writestr("xl/workbook.xml", f'<workbook {self._MAIN} xmlns:r="{self._OFFICE}"><sheets>{sheets}</sheets></workbook>')
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{self._PACKAGE}/relationships">{links}</Relationships>')
        self.zip.writestr("_rels/.rels", f'<Relationships xmlns="{self._PACKAGE}/relationships"><Relationship Id="rId1" Type="{self._OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.zip.writestr("[Content_Types].xml", f'<Types xmlns="{self._PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{self._KIND}.sheet.main+xml"/>{parts}</Types>')
        self.zip.close()
        self.file.close()


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class XlsxWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool) -> None:
        self.path, self.most, self.overwrite = options["path"], int(options.get("rows", ROWS)), overwrite
        self.columns = [n for n in schema.names if n != "sheet_name"]
        if "sheet_name" not in schema.names:
            raise ValueError("the rows need a column sheet_name")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = located(self.path)
        store.create_dir(path, recursive=True)
        names: list[str] = []
        book = None
        for batch in slices(iterator):
            sheets = batch.column("sheet_name").to_pylist()
            columns = [marked(written_text(batch.column(c))) for c in self.columns]
            at = 0
            while at < len(sheets):  # the rows from here on that are of one sheet and have room in the workbook
                sheet, end = sheets[at], at + 1
                while end < len(sheets) and sheets[end] == sheet:
                    end += 1
                if book is None or book.rows >= self.most or sheet in book.sheets[:-1]:
                    if book is not None:
                        book.close()
                    names.append(f".{self.job}-{uuid.uuid4().hex}.xlsx")
                    book = Book(store.open_output_stream(f"{path}/{names[-1]}"), self.columns)
                rows = min(end - at, self.most - book.rows)
                book.put(sheet, [c.slice(at, rows) for c in columns], rows)
                at += rows
        if book is not None:
            book.close()
        return Written(names)

    def commit(self, messages) -> None:
        """Name what the successful tasks wrote; with mode overwrite earlier workbooks go first."""
        store, path = located(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            self.clear(lambda name: name.endswith(".xlsx") and name[0] not in "._")
        for name in (n for m in messages if m is not None for n in m.names):
            store.move(f"{path}/{name}", f"{path}/{name[1:]}")
        self.clear(lambda name: name.startswith(f".{self.job}"))

    def abort(self, messages) -> None:
        self.clear(lambda name: name.startswith(f".{self.job}"))

    def clear(self, which) -> None:
        store, path = located(self.path)
        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.is_file and which(f.base_name):
                store.delete_file(f.path)


class XlsxDataSource(DataSource):
    """Workbook source and sink; options: path, columns, first_row, sheet; rows."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        cells = [StructField(f"c{i + 1}", StringType()) for i in range(int(self.options.get("columns", 16)))]
        return StructType([StructField("sheet_name", StringType()), StructField("row_number", LongType()), *cells])

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options, schema, overwrite)
