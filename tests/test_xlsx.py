"""Workbooks: one made by hand with what other programs write, and a round trip of awkward texts."""

import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratapanel.sources import io, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
LINKS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
DATA = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="D1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>12</v></c><c r="D3" t="b"><v>1</v></c></row>
<row r="4"><c r="B4"><f>1+1</f><v>0.30000000000000004</v></c><c r="C4" t="str"><f>A3</f><v>x &amp; y</v></c><c r="D4" t="e"><v>#N/A</v></c></row>
<row r="5"><c r="A5"/><c r="B5" s="1"/></row>
<row><c t="s"><v>2</v></c><c><v>7</v></c></row>"""
SHARED = """<sst MAIN><si><t>LEAID</t></si><si><r><t>00</t></r><r><rPr><b/></rPr><t xml:space="preserve">1 </t></r><rPh sb="0" eb="1"><t>ignored</t></rPh></si><si><t>a_x000D_b</t></si></sst>"""


def by_hand(path, sheets):
    with zipfile.ZipFile(path, "w") as book:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        links = "".join(f'<Relationship Id="rId{i}" Type="t" Target="{"/xl/" if i > 1 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>{names}</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {LINKS}>{links}</Relationships>")
        book.writestr("xl/sharedStrings.xml", SHARED.replace("MAIN", MAIN))
        for i, data in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{data}</sheetData></worksheet>")


def test_sheets_of_another_program(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    by_hand(path, {"Notes": '<row r="1"><c r="A1" t="s"><v>0</v></c></row>', "Data &amp; more": DATA, "empty": ""})
    got = io.read_sheet(spark, path, "Data & more")
    assert got.columns == ["LEAID", "n", "C", "D"]
    assert [tuple(r) for r in got.collect()] == [("001 ", "12", None, "TRUE"), (None, "0.30000000000000004", "x & y", "#N/A"), ("a\rb", "7", None, None)]
    assert io.read_sheet(spark, path).columns == ["LEAID"] and io.read_sheet(spark, path).count() == 0
    assert io.read_sheet(spark, path, "empty").columns == []
    with pytest.raises(Exception, match="no sheet 'data'"):
        io.read_sheet(spark, path, "data")
    with pytest.raises(Exception, match="other columns"):
        io.read_sheet(spark, path, "*").count()


def test_all_sheets_of_all_workbooks_of_a_folder(spark, tmp_path):
    for i in range(3):
        by_hand(str(tmp_path / f"b{i}.xlsx"), {"one": DATA, "two": DATA})
    every = io.read_sheet(spark, str(tmp_path), "*")
    assert every.count() == 18 and every.rdd.getNumPartitions() == 6
    assert io.read_sheet(spark, str(tmp_path), "two").count() == 9


def test_awkward_texts_and_parts(spark, tmp_path):
    texts = ["<a & 'b'>", " lead", "tab\tand\nline", "ctrl\x01\r", "_x0041_", "日本 😀", "007", None]
    df = spark.createDataFrame([(t, i, i / 3, i % 2 == 0) for i, t in enumerate(texts)], "t string, i int, x double, f boolean")
    path = str(tmp_path / "t")
    io.write_sheet(df, path, sheet='a "b" <c>')
    back = {r.i: tuple(r) for r in io.read_sheet(spark, path, 'a "b" <c>').collect()}
    assert back == {str(i): (t, str(i), str(i / 3), str(i % 2 == 0).upper()) for i, t in enumerate(texts)}
    many = spark.range(0, 1000, numPartitions=1).select(F.col("id").cast("string").alias("k"))
    io.write_sheet(many, path, partRows=300)
    assert len([n for n in os.listdir(path) if n.endswith(".xlsx")]) >= 4
    assert io.read_sheet(spark, path).agg(F.sum(F.col("k").cast("int"))).first()[0] == sum(range(1000))
    io.write_sheet(many.limit(0), path)
    assert io.read_sheet(spark, path).columns == ["k"] and io.read_sheet(spark, path).count() == 0


def test_letters_of_columns():
    assert [xlsx.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(xlsx.place_of(f"{xlsx.letters(i)}7") == i for i in range(0, 16_384, 97))


def test_columns_of_cells_are_numbered_once():
    known = {}
    assert [xlsx.column_of(r, known) for r in ("A1", "AB7", "A22", "b3")] == [0, 27, 0, 1] and set(known) == {"A", "AB", "b"}
    texts = pa.chunked_array([pa.array(["a<", None, "a<", "_x0041_\x01"])])
    assert xlsx.column_xml(texts, "C") == [xlsx.cell_xml(v, f"C{i}") for i, v in enumerate(texts.to_pylist(), 2)]
