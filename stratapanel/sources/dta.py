"""Stata tables (``.dta``, releases 117 to 119) as a Spark data source, read in byte ranges and written in parts.

All records of a file have one width, so after its header has been read once, any range of records is a range of bytes: a large file
is read by as many tasks as it has ranges.  A table is one file or a folder of parts.  On writing, each task makes whole part files of
bounded size beside the table, and the commit publishes the folder by renaming it; what a lost task or a second attempt left is not
published.

A null is Stata's missing value and an empty text is its missing text, so both read as null; the option ``missingCodes`` adds for each
number a text column ``_missing_<name>`` with the code (``.``, ``.a`` to ``.z``), which writing takes back.  Labels of columns travel as
the comment of a column, those of values as ``labels`` in its metadata.  Days and milliseconds (``%td``, ``%tc``) are dates and
timestamps.  Long texts (``strL``, over 2045 bytes) are refused.  The functions here reach tasks by value, so tasks need only pyarrow.
"""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .published import PartWriter, files_of, located

SPLIT_BYTES, BLOCK_BYTES, PART_BYTES = 64 << 20, 8 << 20, 64 << 20

# Fixed values of the format: bytes of a name, a format, a label of a column, and codes of the types.
WIDTHS = {117: (33, 49, 81), 118: (129, 57, 321), 119: (129, 57, 321)}
DOUBLE, FLOAT, LONG, INT, BYTE, LONG_TEXT, MOST_TEXT = 65526, 65527, 65528, 65529, 65530, 32768, 2045
NUMBERS = {DOUBLE: "f8", FLOAT: "f4", LONG: "i4", INT: "i2", BYTE: "i1"}
#: The missing value ``.`` and the step to the next code; for floating numbers in their bits.
MISSING = {DOUBLE: (0x7FE0000000000000, 0x10000000000), FLOAT: (0x7F000000, 0x800), LONG: (2147483621, 1), INT: (32741, 1), BYTE: (101, 1)}
LEAST = {LONG: -2147483647, INT: -32767, BYTE: -127}
BITS = {DOUBLE: "u8", FLOAT: "u4"}
CODES = [".", *(f".{chr(c)}" for c in range(ord("a"), ord("z") + 1))]
#: Days from 1960 to 1970.
EPOCH = 3653
SECTIONS = (
    "stata_dta map variable_types varnames sortlist formats value_label_names variable_labels characteristics data strls value_labels".split()
)
PREFIX = "_missing_"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,31}")


class Field(NamedTuple):
    name: str
    code: int
    format: str
    label: str
    labels: dict[int, str]

    def width(self) -> int:
        return self.code if self.code <= MOST_TEXT else np.dtype(NUMBERS[self.code]).itemsize

    def kind(self) -> str:
        if self.code <= MOST_TEXT:
            return "text"
        return {"%td": "date", "%tc": "time"}.get(self.format[:3], "number") if not self.format.startswith("%d") else "date"

    def type(self) -> T.DataType:
        if self.kind() != "number":
            return {"text": T.StringType(), "date": T.DateType(), "time": T.TimestampNTZType()}[self.kind()]
        return {DOUBLE: T.DoubleType(), FLOAT: T.FloatType(), LONG: T.IntegerType(), INT: T.ShortType(), BYTE: T.ByteType()}[self.code]


class Layout(NamedTuple):
    """What a file's header says."""

    order: str
    encoding: str
    fields: tuple[Field, ...]
    rows: int
    start: int

    def width(self) -> int:
        return sum(f.width() for f in self.fields)

    def dtype(self) -> np.dtype:
        kinds = [f"S{f.code}" if f.code <= MOST_TEXT else self.order + NUMBERS[f.code] for f in self.fields]
        return np.dtype([(f"f{i}", k) for i, k in enumerate(kinds)])


def text_of(raw: bytes, encoding: str) -> str:
    return raw.split(b"\0", 1)[0].decode(encoding)


def value_labels(raw: bytes, order: str, wide: int, encoding: str) -> dict[str, dict[int, str]]:
    """Label sets by name."""
    sets, at = {}, 0
    while (at := raw.find(b"<lbl>", at)) >= 0:
        (size,) = struct.unpack_from(order + "i", raw, at + 5)
        name = text_of(raw[at + 9 : at + 9 + wide], encoding)
        body = raw[at + 9 + wide + 3 : at + 9 + wide + 3 + size]
        n, _ = struct.unpack_from(order + "2i", body)
        offsets, values = struct.unpack_from(f"{order}{n}i", body, 8), struct.unpack_from(f"{order}{n}i", body, 8 + 4 * n)
        texts = body[8 + 8 * n :]
        sets[name] = {v: text_of(texts[o:], encoding) for o, v in zip(offsets, values, strict=True)}
        at += 9 + wide + 3 + size
    return sets


def layout_of(file: pa.NativeFile, path: str) -> Layout:
    head = file.read(4096)
    found = re.match(rb"<stata_dta><header><release>(\d+)</release><byteorder>(LSF|MSF)</byteorder><K>", head)
    if not found or int(found[1]) not in WIDTHS:
        raise ValueError(f"{path} is no .dta file of release 117 to 119")
    release, order = int(found[1]), "<" if found[2] == b"LSF" else ">"
    encoding = "latin-1" if release == 117 else "utf-8"
    k_code, n_code = ("I" if release == 119 else "H"), ("I" if release == 117 else "Q")
    at = found.end()
    (k,) = struct.unpack_from(order + k_code, head, at)
    (n,) = struct.unpack_from(order + n_code, head, at + struct.calcsize("<" + k_code) + len("</K><N>"))
    places = dict(zip(SECTIONS, struct.unpack_from(order + "12q", head, head.index(b"<map>") + 5), strict=True))
    (after,) = struct.unpack_from(order + "q", head, head.index(b"<map>") + 5 + 8 * 12)
    file.seek(places["variable_types"])
    base, body = places["variable_types"], file.read(places["characteristics"] - places["variable_types"])

    name_width, format_width, label_width = WIDTHS[release]

    def section(name: str, width: int) -> list[bytes]:
        """An entry of fixed width for each column."""
        low = places[name] - base + len(f"<{name}>")
        return [body[low + i * width : low + (i + 1) * width] for i in range(k)]

    file.seek(places["value_labels"])
    sets = value_labels(file.read(after - places["value_labels"]), order, name_width, encoding)

    def texts(name: str, width: int) -> list[str]:
        return [text_of(raw, encoding) for raw in section(name, width)]

    codes = [struct.unpack(order + "H", raw)[0] for raw in section("variable_types", 2)]
    names = texts("varnames", name_width)
    long = [name for name, code in zip(names, codes, strict=True) if code == LONG_TEXT]
    if long:
        raise ValueError(f"{path}: long texts (strL) are not read: {long}")
    parts = zip(names, codes, texts("formats", format_width), texts("variable_labels", label_width), texts("value_label_names", name_width), strict=True)
    fields = tuple(Field(name, code, form, label, sets.get(held, {})) for name, code, form, label, held in parts)
    return Layout(order, encoding, fields, n, places["data"] + len("<data>"))


def schema_of(layout: Layout, codes: bool) -> T.StructType:
    out = []
    for f in layout.fields:
        metadata: dict[str, Any] = {"format": f.format}
        metadata |= {"comment": f.label} if f.label else {}
        metadata |= {"labels": {str(v): t for v, t in f.labels.items()}} if f.labels else {}
        out.append(T.StructField(f.name, f.type(), True, metadata))
    if codes:
        out += [T.StructField(PREFIX + f.name, T.StringType()) for f in layout.fields if f.kind() != "text"]
    return T.StructType(out)


def missing_at(values: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """Which numbers are missing, and by which code."""
    first, step = MISSING[code]
    raw = values.view(BITS[code]) if code in BITS else values.astype(np.int64)
    missing = raw >= first
    if code in BITS:
        missing &= raw < (1 << 8 * values.itemsize - 1)  # the sign bit: negative numbers are not missing
    number = (raw.astype(np.uint64) - np.uint64(first)) // np.uint64(step) if code in BITS else (raw - first) // step
    return missing, np.where(missing, np.minimum(number, len(CODES) - 1), 0).astype(np.int64)


def batch_of(records: np.ndarray, layout: Layout, codes: bool) -> pa.RecordBatch:
    columns, said, names = [], [], []
    for i, f in enumerate(layout.fields):
        names.append(f.name)
        values = records[f"f{i}"]
        if f.kind() == "text":
            texts = [v.split(b"\0", 1)[0].decode(layout.encoding) for v in values.tolist()]
            columns.append(pa.array([t or None for t in texts], pa.string()))
            continue
        values = np.ascontiguousarray(values).astype(NUMBERS[f.code])
        missing, which = missing_at(values, f.code)
        if f.kind() == "number":
            columns.append(pa.array(values, mask=missing))
        else:
            days = f.kind() == "date"
            moved = np.where(missing, 0, values).astype(np.int64) - (EPOCH if days else EPOCH * 86_400_000)
            columns.append(pa.array(moved.astype(np.int32), pa.date32(), mask=missing) if days else pa.array(moved * 1000, pa.timestamp("us"), mask=missing))
        if codes:
            said.append(pa.array([CODES[w] if m else None for m, w in zip(missing.tolist(), which.tolist(), strict=True)], pa.string()))
            names.append("")
    if codes:
        names = [n for n in names if n] + [PREFIX + f.name for f in layout.fields if f.kind() != "text"]
    return pa.RecordBatch.from_arrays(columns + said, names=names)


class Range(InputPartition):
    def __init__(self, path: str, layout: Layout, first: int, rows: int):
        super().__init__((path, first, rows))
        self.path, self.layout, self.first, self.rows = path, layout, first, rows


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split: int, codes: bool):
        self.path, self.schema, self.split, self.codes = path, schema, split, codes

    def partitions(self) -> Sequence[InputPartition]:
        files, path = located(self.path)
        out = []
        for name in files_of(files, path, ".dta"):
            with files.open_input_file(name) as file:
                layout = layout_of(file, name)
            if schema_of(layout, self.codes).simpleString() != self.schema.simpleString():
                raise ValueError(f"{name} has other columns than the first file of {self.path}")
            each = max(1, self.split // max(1, layout.width()))
            out += [Range(name, layout, low, min(each, layout.rows - low)) for low in range(0, layout.rows, each)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Range):
            return
        files, _ = located(self.path)
        layout = partition.layout
        width, kind = layout.width(), layout.dtype()
        with files.open_input_file(partition.path) as file:
            file.seek(layout.start + partition.first * width)
            left = partition.rows
            while left:
                n = min(left, max(1, BLOCK_BYTES // width))
                raw = file.read(n * width)
                if len(raw) < n * width:
                    raise ValueError(f"{partition.path} ends before its last record")
                yield batch_of(np.frombuffer(raw, kind), layout, self.codes)
                left -= n


def packed(column: pa.ChunkedArray, field: T.StructField, codes: list | None) -> tuple[Field, np.ndarray]:
    """A column as a field and its values, missing ones by their code."""
    name, kind, metadata = field.name, field.dataType, field.metadata or {}
    label = metadata.get("comment", "")
    labels = {int(v): t for v, t in metadata.get("labels", {}).items()}
    if isinstance(kind, T.StringType):
        raw = [(t or "").encode() for t in column.to_pylist()]
        width = max(1, max(map(len, raw), default=1))
        if width > MOST_TEXT:
            raise ValueError(f"a text of column {name} has {width} bytes, over {MOST_TEXT}")
        return Field(name, width, f"%{width}s", label, {}), np.array(raw, f"S{width}")
    form = metadata.get("format")
    if isinstance(kind, T.DateType):
        code, form, column = LONG, "%td", pa.chunked_array([c.cast(pa.int32()) for c in column.chunks], pa.int32())
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        code, form = DOUBLE, "%tc"
        column = pa.chunked_array([c.cast(pa.timestamp("us", c.type.tz)).cast(pa.int64()) for c in column.chunks], pa.int64())
    else:
        kinds = {T.BooleanType: BYTE, T.ByteType: BYTE, T.ShortType: INT, T.IntegerType: LONG, T.LongType: DOUBLE, T.FloatType: FLOAT, T.DoubleType: DOUBLE}
        code = DOUBLE if isinstance(kind, T.DecimalType) else kinds.get(type(kind))
        if code is None:
            raise ValueError(f"column {name} of type {kind.simpleString()} has no type in a .dta file")
    null = column.is_null().to_numpy()
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        filled = column.cast(pa.float64()).fill_null(0.0).to_numpy()
        null = null | np.isnan(filled)
        high = np.array([MISSING[code][0]], BITS[code]).view(NUMBERS[code])[0]
    else:
        filled = column.cast(pa.int64()).fill_null(0).to_numpy()
        filled = filled + EPOCH if form == "%td" and isinstance(kind, T.DateType) else filled
        if code == DOUBLE and form == "%tc":
            filled = filled / 1000 + EPOCH * 86_400_000.0
        high = 2**53 + 1 if isinstance(kind, T.LongType) else MISSING[code][0]
    low = -(2**53) if isinstance(kind, T.LongType) else LEAST.get(code, -high)
    bad = ~null & ((filled >= high) | (filled < low))
    if bad.any():
        raise ValueError(f"value {filled[bad][0]} of column {name} is out of the range of its type in a .dta file")
    values = np.where(null, 0, filled).astype(NUMBERS[code])
    first, step = MISSING[code]
    at = np.flatnonzero(null)
    if len(at):
        which = np.array([CODES.index(codes[i]) if codes and codes[i] in CODES else 0 for i in at], np.uint64)
        raw = np.uint64(first) + which * np.uint64(step)
        values[at] = raw.astype(BITS[code]).view(NUMBERS[code]) if code in BITS else raw.astype(NUMBERS[code])
    return Field(name, code, form or {DOUBLE: "%10.0g", FLOAT: "%9.0g", LONG: "%12.0g"}.get(code, "%8.0g"), label, labels), values


def file_of(table: pa.Table, schema: T.StructType) -> bytes:
    """A whole .dta file of release 118."""
    name_width, format_width, label_width = WIDTHS[118]
    given = set(schema.names)
    own = [f for f in schema.fields if not (f.name.startswith(PREFIX) and f.name.removeprefix(PREFIX) in given)]
    for f in own:
        if not NAME.fullmatch(f.name):
            raise ValueError(f"{f.name} is no name of a column in a .dta file")
    made = [packed(table[f.name], f, table[PREFIX + f.name].to_pylist() if PREFIX + f.name in given else None) for f in own]
    fields = [f for f, _ in made]
    layout = Layout("<", "utf-8", tuple(fields), table.num_rows, 0)
    records = np.zeros(table.num_rows, layout.dtype())
    for i, (_, values) in enumerate(made):
        records[f"f{i}"] = values

    def fixed(texts: Sequence[str], width: int) -> bytes:
        return b"".join(t.encode()[: width - 1].decode(errors="ignore").encode().ljust(width, b"\0") for t in texts)

    def label_set(f: Field) -> bytes:
        texts = [t.encode() + b"\0" for t in f.labels.values()]
        offsets = np.cumsum([0, *map(len, texts)])[:-1].tolist()
        body = struct.pack(f"<2i{2 * len(texts)}i", len(texts), sum(map(len, texts)), *offsets, *f.labels) + b"".join(texts)
        return b"<lbl>" + struct.pack("<i", len(body)) + fixed([f.name], name_width) + b"\0\0\0" + body + b"</lbl>"

    k = len(fields)
    bodies = {
        "variable_types": struct.pack(f"<{k}H", *(f.code for f in fields)), "varnames": fixed([f.name for f in fields], name_width),
        "sortlist": bytes(2 * (k + 1)), "formats": fixed([f.format for f in fields], format_width),
        "value_label_names": fixed([f.name if f.labels else "" for f in fields], name_width),
        "variable_labels": fixed([f.label[:80] for f in fields], label_width), "characteristics": b"", "data": records.tobytes(), "strls": b"",
        "value_labels": b"".join(label_set(f) for f in fields if f.labels),
    }
    head = b"<stata_dta><header><release>118</release><byteorder>LSF</byteorder><K>" + struct.pack("<H", k) + b"</K><N>" + struct.pack("<Q", table.num_rows)
    head += b"</N><label>\0\0</label><timestamp>\0</timestamp></header>"
    places, at = [0, len(head)], len(head) + len("<map></map>") + 8 * 14
    out = []
    for name, body in bodies.items():
        places.append(at)
        out.append(f"<{name}>".encode() + body + f"</{name}>".encode())
        at += len(out[-1])
    places += [at, at + len("</stata_dta>")]
    return b"".join([head, b"<map>", struct.pack("<14q", *places), b"</map>", *out, b"</stata_dta>"])


class Writer(PartWriter):
    suffix = ".dta"

    def file_of(self, table: pa.Table) -> bytes:
        return file_of(table, self.schema)


class DtaSource(DataSource):
    """``spark.read.format("dta").load(path)``; options ``splitBytes``, ``missingCodes``, ``partBytes``."""

    @classmethod
    def name(cls) -> str:
        return "dta"

    def _codes(self) -> bool:
        return str(self.options.get("missingCodes", "false")).lower() == "true"

    def schema(self) -> T.StructType:
        files, path = located(self.options["path"])
        first = files_of(files, path, ".dta")[0]
        with files.open_input_file(first) as file:
            return schema_of(layout_of(file, first), self._codes())

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("splitBytes", SPLIT_BYTES)), self._codes())

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite, int(self.options.get("partBytes", PART_BYTES)))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
