"""Workbooks written and read back, and workbooks as other programs write them."""

import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lexigauge.sources import workbooks


def test_names_of_columns():
    assert [workbooks.letters(i) for i in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(workbooks.number(workbooks.letters(i) + "7") == i for i in range(2000))


def test_round_trip(spark, tmp_path):
    rows = [(0, "a <b> & \"c\" 'd'", 1.5, 7), (1, "  blanks\tand\nlines ", None, 9), (2, "鱼 é 😀", -2e300, 9), (3, None, 0.1, None), (4, "", 1.0, 1)]
    d = spark.createDataFrame(rows, "row long, name string, x double, n int")
    cells = workbooks.cells_of(d, "one & <two>", ["name", "x", "n"], [("name", ""), ("scores", "x"), ("scores", "n")], ("x", "n"))
    more = workbooks.cells_of(d.select("row", "n"), "other", ["n"], [("n",)])
    at = str(tmp_path / "book.xlsx")
    for _ in range(2):  # the second replaces the first
        workbooks.write(cells.unionByName(more), at, ["other", "one & <two>", "empty"])
    with zipfile.ZipFile(at) as z:
        assert all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
    got = workbooks.read(spark, at)
    key = lambda r: (r.sheet, r.row, r.col, r.text, r.number, r.bold)
    assert sorted(map(repr, map(key, got.collect()))) == sorted(map(repr, map(key, cells.unionByName(more).collect())))
    bold = {(r.row, r.col) for r in got.filter("bold AND row > 1 AND sheet <> 'other'").collect()}
    assert bold == {(2, 1), (3, 2), (4, 2)}
    t = workbooks.table(got, "one & <two>", 2)
    assert t.columns == ["row", "name", "scores/x", "scores/n"]
    assert [tuple(r) for r in t.orderBy("row").collect()] == [(i, s, x, None if n is None else float(n)) for i, s, x, n in rows]
    assert workbooks.table(got, "other").columns == ["row", "n"] and workbooks.table(got, "none").count() == 0


def test_books_of_other_programs(spark, tmp_path):
    """Shared texts in runs, booleans, formulas with values, cells without, bold fonts switched off, targets from the root."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{workbooks.MAIN}" xmlns:r="{workbooks.REL}"><sheets><sheet name="s" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbooks.PACKAGE}/relationships"><Relationship Id="a" Type="x" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbooks.MAIN}"><si><t>whole</t></si><si><r><t>in </t></r><r><t>runs</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{workbooks.MAIN}"><fonts><font><b/></font><font><b val="0"/></font></fonts><cellXfs><xf fontId="1"/><xf fontId="0"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{workbooks.MAIN}"><sheetData><row r="3"><c r="B3" t="s" s="1"><v>1</v></c><c r="C3"><f>1+1</f><v>2</v></c><c r="D3" s="1"/><c r="AA3" t="b"><v>1</v></c><c r="AB3" t="str"><v>text</v></c></row></sheetData></worksheet>')
    for name in ("x.xlsx", "y.xlsx"):
        (tmp_path / name).write_bytes(out.getvalue())
    got = workbooks.read(spark, f"{tmp_path}/*.xlsx").orderBy("path", "col").collect()
    assert [tuple(r)[:6] for r in got] == 2 * [("s", 2, 1, "in runs", None, True), ("s", 2, 2, None, 2.0, False), ("s", 2, 26, "1", None, False), ("s", 2, 27, "text", None, False)]
    assert {r.path.rsplit("/", 1)[1] for r in got} == {"x.xlsx", "y.xlsx"}


def test_too_many_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "CELLS", 5)
    cells = workbooks.cells_of(spark.range(9).withColumnRenamed("id", "row").withColumn("v", F.col("row")), "s", ["v"], [("v",)])
    with pytest.raises(ValueError, match="10 cells"):
        workbooks.write(cells, str(tmp_path / "x.xlsx"), ["s"])
