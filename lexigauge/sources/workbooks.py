"""Excel workbooks in and out, as tables of cells.

A workbook is a report: its format bounds a sheet (1,048,576 rows, 16,384
columns), and ``write`` refuses more than ``CELLS`` cells, so one task may build
it. Many workbooks are read at once, each by one task, through Spark's own
readers, wherever they are stored.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = 2_000_000
CELL = "sheet string, row long, col long, text string, number double, bold boolean"
# Names of the parts of a workbook and of their vocabularies.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml."


def letters(col: int) -> str:
    """Name of a column: 0 is A, 26 is AA."""
    out = ""
    while col >= 0:
        out, col = chr(65 + col % 26) + out, col // 26 - 1
    return out


def number(name: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", name)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


# -- cells of tables


def cells_of(df: DataFrame, sheet: str, columns: list[str], headers: list[tuple[str, ...]], best: tuple[str, ...] = ()) -> DataFrame:
    """``CELL`` rows of a table whose ``row`` column numbers its rows from 0: header rows first, the largest value of each ``best`` column bold.

    A header cell that repeats the one to its left, under the same cells, is left blank, as a merged one is.
    """
    spark, depth = df.sparkSession, len(headers[0])
    top = [(sheet, r, c, h[r], None, True) for c, h in enumerate(headers) for r in range(depth) if c == 0 or headers[c - 1][: r + 1] != h[: r + 1] or r == depth - 1]
    kinds = dict(df.dtypes)
    text = [kinds[c] == "string" for c in columns]
    most = df.agg(*[F.max(c).alias(c) for c in best], F.lit(1).alias("__one")).first() if best else None  # one row
    cell = lambda i, c: F.struct(F.lit(i).cast("long").alias("col"), (F.col(c) if text[i] else F.lit(None).cast("string")).alias("text"), (F.lit(None) if text[i] else F.col(c)).cast("double").alias("number"), (F.col(c) == F.lit(most[c]) if c in best else F.lit(False)).alias("bold"))
    rows = df.select((F.col("row") + depth).cast("long").alias("row"), F.explode(F.array(*[cell(i, c) for i, c in enumerate(columns)])).alias("c"))
    rows = rows.select(F.lit(sheet).alias("sheet"), "row", "c.col", "c.text", "c.number", F.coalesce("c.bold", F.lit(False)).alias("bold"))
    return spark.createDataFrame(top, CELL).unionByName(rows.filter("text IS NOT NULL OR number IS NOT NULL"))


# -- out


def _sheet(cells: pd.DataFrame) -> str:
    wide = {}
    rows = []
    for r, line in cells.groupby("row", sort=True):
        out = []
        for c in line.sort_values("col").itertuples():
            at, style = f'r="{letters(c.col)}{r + 1}"', ' s="1"' if c.bold else ""
            said = c.text if c.text is not None else repr(float(c.number))
            wide[c.col] = max(wide.get(c.col, 0), len(said))
            out.append(f'<c {at}{style} t="inlineStr"><is><t xml:space="preserve">{escape(said)}</t></is></c>' if c.text is not None else f"<c {at}{style}><v>{said}</v></c>")
        rows.append(f'<row r="{r + 1}">{"".join(out)}</row>')
    cols = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{min(n + 2, 255)}" customWidth="1"/>' for c, n in sorted(wide.items()))
    return f'<worksheet xmlns="{MAIN}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{"".join(rows)}</sheetData></worksheet>'


def build(cells: pd.DataFrame, names: list[str]) -> bytes:
    """A workbook of sheets in the order of ``names``."""
    n, out = len(names), io.BytesIO()
    kinds = [("workbook", "sheet.main"), ("styles", "styles"), *[(f"worksheets/sheet{i + 1}", "worksheet") for i in range(n)]]
    links = [(f"rId{i + 1}", "worksheet", f"worksheets/sheet{i + 1}.xml") for i in range(n)] + [(f"rId{n + 1}", "styles", "styles.xml")]
    relations = lambda rs: f'<Relationships xmlns="{PACKAGE}/relationships">{"".join(f"""<Relationship Id="{i}" Type="{REL}/{t}" Target="{to}"/>""" for i, t, to in rs)}</Relationships>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        + "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{TYPES}{k}+xml"/>' for p, k in kinds) + "</Types>",
        "_rels/.rels": relations([("rId1", "officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{"".join(f"""<sheet name={quoteattr(s)} sheetId="{i + 1}" r:id="rId{i + 1}"/>""" for i, s in enumerate(names))}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(links),
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        **{f"xl/worksheets/sheet{i + 1}.xml": _sheet(cells[cells["sheet"] == s]) for i, s in enumerate(names)},
    }
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + part, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write(cells: DataFrame, path: str, names: list[str]) -> None:
    """Writes one workbook; a file that is there is replaced."""
    spark = cells.sparkSession
    n = cells.count()
    if n > CELLS:
        raise ValueError(f"{n} cells are no report; write a table instead")
    book = build(cells.toPandas(), names)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(book)
    out.close()


# -- in


def read_book(book: bytes) -> list[tuple]:
    """(sheet, row, col, text, number, bold) of each cell that holds something."""
    q = lambda t: f"{{{MAIN}}}{t}"
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        xml = lambda name: ElementTree.fromstring(z.read(name))
        there = set(z.namelist())
        words = ["".join(t.text or "" for t in si.iter(q("t"))) for si in xml("xl/sharedStrings.xml").iter(q("si"))] if "xl/sharedStrings.xml" in there else []
        bold: list[bool] = []
        if "xl/styles.xml" in there:
            styles = xml("xl/styles.xml")
            fonts = [f.find(q("b")) is not None and f.find(q("b")).get("val", "1") not in ("0", "false") for f in styles.iterfind(f"{q('fonts')}/{q('font')}")]
            bold = [fonts[int(x.get("fontId", 0))] if fonts else False for x in styles.iterfind(f"{q('cellXfs')}/{q('xf')}")]
        targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        out = []
        for s in xml("xl/workbook.xml").iter(q("sheet")):
            to = targets[s.get(f"{{{REL}}}id")]
            for c in xml(to[1:] if to.startswith("/") else f"xl/{to}").iter(q("c")):
                kind, v = c.get("t", "n"), c.find(q("v"))
                if kind == "inlineStr":
                    text, num = "".join(t.text or "" for t in c.iter(q("t"))), None
                elif v is None or v.text is None:
                    continue
                elif kind == "n":
                    text, num = None, float(v.text)
                else:
                    text, num = words[int(v.text)] if kind == "s" else v.text, None
                style = int(c.get("s", 0))
                out.append((s.get("name"), int(re.search("[0-9]+", c.get("r"))[0]) - 1, number(c.get("r")), text, num, style < len(bold) and bold[style]))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, and ``CELL``) of each cell of the workbooks that a path or pattern names."""
    names = [f.split()[0] for f in CELL.split(", ")]

    def run(frames):
        for f in frames:
            for p, book in zip(f["path"], f["content"]):
                d = pd.DataFrame(read_book(book), columns=names)
                d["path"] = p
                yield d

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"{CELL}, path string")


def table(cells: DataFrame, sheet: str, header_rows: int = 1, join: str = "/") -> DataFrame:
    """A sheet of one workbook as a table: a column for each header, of one or more rows, whose blanks continue the cell to their left; and ``row`` from 0.

    Values are text where a column holds any, else numbers. The headers are read first; there are as many as columns.
    """
    d = cells.filter(F.col("sheet") == sheet)
    top = d.filter(F.col("row") < header_rows).select("row", "col", F.coalesce("text", F.col("number").cast("string")).alias("t")).collect()
    kinds = {r.col: r.n for r in d.filter(F.col("row") >= header_rows).groupBy("col").agg(F.count("text").alias("n")).collect()}
    given = {(r.row, r.col): r.t for r in top}
    names, above = {}, [None] * header_rows
    for c in range(max([*kinds, *(k[1] for k in given)], default=-1) + 1):
        for r in range(header_rows):
            if (r, c) in given:
                above[r:] = [given[r, c], *[None] * (header_rows - r - 1)]
        names[c] = join.join(x for x in above if x) or letters(c)
    value = lambda c: F.max(F.when(F.col("col") == c, F.coalesce("text", F.col("number").cast("string")) if kinds.get(c) else F.col("number"))).alias(names[c])
    return d.filter(F.col("row") >= header_rows).groupBy((F.col("row") - header_rows).alias("row")).agg(F.count(F.lit(1)).alias("__n"), *map(value, names)).drop("__n")
