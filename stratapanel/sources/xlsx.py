"""Workbooks (``.xlsx``) as a Spark data source: one partition for each file and sheet, rows streamed from its XML.

The first row names the columns; a blank or repeated name is replaced by the column's letters.  Every cell is text as the file holds it,
so no id loses a zero that it has; empty cells are null.  A sheet has at most 1,048,576 rows, which bounds a task, and is read from
start to end without being held; only the texts that a workbook's cells share are.  Writing makes a folder of workbooks with one sheet
each, published when all of it is written.  Formulas count with their stored value, styles not at all.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator, Sequence
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .published import PartWriter, files_of, located

# Fixed values of the format.
MOST_ROWS = 1_048_576
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROW, CELL, TEXT, VALUE, INLINE = (f"{MAIN}{name}" for name in ("row", "c", "t", "v", "is"))
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
BATCH_ROWS, PART_BYTES = 5000, 64 << 20
ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
UNPRINTED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\r\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def letters(place: int) -> str:
    """Letters of a column, from 0 on: A, B, ..., Z, AA, ..."""
    out = ""
    place += 1
    while place:
        place, rest = divmod(place - 1, 26)
        out = chr(65 + rest) + out
    return out


def place_of(reference: str) -> int:
    """Column of a cell such as ``AB12``, from 0 on."""
    place = 0
    for c in reference:
        if not c.isalpha():
            break
        place = 26 * place + ord(c.upper()) - 64
    return place - 1


def column_of(reference: str, known: dict[str, int]) -> int:
    """``place_of``, worked out once for each column's letters."""
    name = reference.rstrip("0123456789")
    place = known.get(name)
    if place is None:
        place = known[name] = place_of(name)
    return place


def plain(text: str) -> str:
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def text_in(node: ElementTree.Element) -> str:
    """Text of a cell or a shared text, runs joined; pronunciation guides left out."""
    if len(node) == 1 and node[0].tag == TEXT:
        return plain(node[0].text or "")
    parts = node.findall(f"{MAIN}t") + [t for run in node.findall(f"{MAIN}r") for t in run.findall(f"{MAIN}t")]
    return plain("".join(t.text or "" for t in parts))


def sheets_of(book: zipfile.ZipFile) -> dict[str, str]:
    """Member of each sheet by its name, in the workbook's order."""
    links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
    found = {}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = links[sheet.get(f"{LINK}id")]
        found[sheet.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return found


def shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    texts = []
    with book.open("xl/sharedStrings.xml") as file:
        for _, node in ElementTree.iterparse(file):
            if node.tag == f"{MAIN}si":
                texts.append(text_in(node))
                node.clear()
    return texts


def rows_of(book: zipfile.ZipFile, member: str, texts: list[str]) -> Iterator[dict[int, str]]:
    """Cells by column of each row that the sheet holds, in order."""
    with book.open(member) as file:
        held = ElementTree.iterparse(file, events=("start", "end"))
        data, known = None, {}
        for event, node in held:
            if event == "start":
                data = node if node.tag == f"{MAIN}sheetData" else data
                continue
            if node.tag != ROW:
                continue
            cells, place = {}, -1
            for cell in node.iter(CELL):
                reference = cell.get("r")
                place = column_of(reference, known) if reference else place + 1
                kind = cell.get("t")
                value = None if kind == "inlineStr" else cell.find(VALUE)
                if kind == "inlineStr":
                    inner = cell.find(INLINE)
                    text = text_in(inner) if inner is not None else ""
                elif value is None or value.text is None:
                    continue
                elif kind == "s":
                    text = texts[int(value.text)]
                elif kind == "b":
                    text = "TRUE" if value.text == "1" else "FALSE"
                else:
                    text = plain(value.text) if kind == "str" else value.text
                if text:
                    cells[place] = text
            yield cells
            if data is not None:
                data.clear()


def header_of(cells: dict[int, str]) -> list[str]:
    names: list[str] = []
    for i in range(max(cells, default=-1) + 1):
        name = cells.get(i, "").strip()
        names.append(letters(i) if not name or name in names else name)
    return names


class Sheet(InputPartition):
    def __init__(self, path: str, sheet: str):
        super().__init__((path, sheet))
        self.path, self.sheet = path, sheet


def chosen(book: zipfile.ZipFile, wanted: str | None, path: str) -> list[str]:
    """Names of the wanted sheets: the first, the named one, or all (``*``)."""
    names = list(sheets_of(book))
    if wanted is None or wanted == "*":
        return names[:1] if wanted is None else names
    if wanted not in names:
        raise ValueError(f"no sheet {wanted!r} in {path}; there are {names}")
    return [wanted]


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, sheet: str | None):
        self.path, self.names, self.sheet = path, schema.names, sheet

    def partitions(self) -> Sequence[InputPartition]:
        files, path = located(self.path)
        out = []
        for name in files_of(files, path, ".xlsx"):
            with files.open_input_file(name) as file, zipfile.ZipFile(file) as book:
                out += [Sheet(name, s) for s in chosen(book, self.sheet, name)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, _ = located(self.path)
        with files.open_input_file(partition.path) as file, zipfile.ZipFile(file) as book:
            rows = rows_of(book, sheets_of(book)[partition.sheet], shared_texts(book))
            names = header_of(next(rows, {}))
            if names != self.names:
                raise ValueError(f"sheet {partition.sheet!r} of {partition.path} has other columns than the first sheet read")
            held: list[dict[int, str]] = []

            def batch() -> pa.RecordBatch:
                columns = [pa.array([r.get(i) for r in held], pa.string()) for i in range(len(names))]
                return pa.RecordBatch.from_arrays(columns, names=names)

            for cells in rows:
                if cells:
                    held.append(cells)
                if len(held) == BATCH_ROWS:
                    yield batch()
                    held.clear()
            if held:
                yield batch()


def cell_xml(value, reference: str) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)):
        return f'<c r="{reference}"><v>{value}</v></c>'
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{text_xml(str(value))}</t></is></c>'


def text_xml(text: str) -> str:
    return escape(UNPRINTED.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def column_xml(column: pa.ChunkedArray, name: str) -> list[str]:
    """The cells of a column below its name.  Each different text is written out once."""
    values = column.to_pylist()
    if not pa.types.is_string(column.type):
        return [cell_xml(v, f"{name}{i}") for i, v in enumerate(values, 2)]
    told = {v: f'" t="inlineStr"><is><t xml:space="preserve">{text_xml(v)}</t></is></c>' for v in set(values) if v is not None}
    return ["" if v is None else f'<c r="{name}{i}{told[v]}' for i, v in enumerate(values, 2)]


def book_of(table: pa.Table, sheet: str) -> bytes:
    """A workbook of one sheet."""
    space = MAIN.strip("{}")
    columns = [letters(i) for i in range(table.num_columns)]
    rows = [f'<row r="1">{"".join(cell_xml(n, c + "1") for n, c in zip(table.column_names, columns, strict=True))}</row>']
    written = [column_xml(c, name) for c, name in zip(table.columns, columns, strict=True)]
    rows += [f'<row r="{i}">{"".join(row)}</row>' for i, row in enumerate(zip(*written, strict=True), 2)]
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    start = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    package, office = PACKAGE.strip("{}"), LINK.strip("{}")
    members = {
        "[Content_Types].xml": f'{start}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{types}sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}worksheet+xml"/></Types>',
        "_rels/.rels": f'{start}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{start}<workbook xmlns="{space}" xmlns:r="{office}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{start}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{start}<worksheet xmlns="{space}"><sheetData>{"".join(rows)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in members.items():
            book.writestr(name, text)
    return out.getvalue()


class Writer(PartWriter):
    suffix = ".xlsx"
    sheet = "Sheet1"

    def file_of(self, table: pa.Table) -> bytes:
        return book_of(table, self.sheet)


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").option("sheet", name).load(path)``; writing takes ``sheet`` and ``partRows``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        files, path = located(self.options["path"])
        first = files_of(files, path, ".xlsx")[0]
        with files.open_input_file(first) as file, zipfile.ZipFile(file) as book:
            sheet = chosen(book, self.options.get("sheet"), first)[0]
            names = header_of(next(rows_of(book, sheets_of(book)[sheet], shared_texts(book)), {}))
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema, self.options.get("sheet"))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        rows = min(MOST_ROWS - 1, int(self.options.get("partRows", MOST_ROWS - 1)))
        made = Writer(self.options["path"], schema, overwrite, PART_BYTES, rows)
        made.sheet = self.options.get("sheet", "Sheet1")
        return made


cloudpickle.register_pickle_by_value(sys.modules[__name__])
