"""Word documents and workbooks as tables, read and written by zip and XML alone.

Readers take ``binaryFile`` rows and run as map-only Arrow batches; a damaged file gives a row with ``error`` instead of
failing the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.session import python_trim

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DOCX_SCHEMA = "path string, kind string, table_ix int, row_ix int, cell_ix int, depth int, para_ix int, text string, error string"
XLSX_SCHEMA = "path string, sheet string, ref string, type string, text string, number double, flag boolean, formula string, style string, error string"


def binary_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def _text(element) -> str:
    return "".join((t.text or "") if t.tag == f"{W}t" else "\n" if t.tag == f"{W}br" else "\t" if t.tag == f"{W}tab" else "" for t in element.iter())


def docx_rows(path: str, content: bytes) -> list[tuple]:
    """Paragraphs and cells in document order; continued vertical merges show the text of the cell above."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    tables = 0

    def table(element, depth: int) -> None:
        nonlocal tables
        me, tables = tables, tables + 1
        above: dict[int, str] = {}
        for r, row in enumerate(element.findall(f"{W}tr")):
            for k, cell in enumerate(row.findall(f"{W}tc")):
                merge = cell.find(f"{W}tcPr/{W}vMerge")
                text = "\n".join(_text(p) for p in cell.findall(f"{W}p"))
                if merge is not None and merge.get(f"{W}val", "continue") == "continue":
                    text = above.get(k, "")
                above[k] = text
                for nested in cell.findall(f"{W}tbl"):
                    table(nested, depth + 1)
                out.append((path, "cell", me, r, k, depth, None, text, None))

    for i, element in enumerate(body if body is not None else []):
        if element.tag == f"{W}p":
            out.append((path, "paragraph", None, None, None, 0, i, _text(element), None))
        elif element.tag == f"{W}tbl":
            table(element, 0)
    return out


def xlsx_rows(path: str, content: bytes) -> list[tuple]:
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")] if "xl/sharedStrings.xml" in names else []
        for name in sorted(n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)):
            for c in ET.fromstring(z.read(name)).iter(f"{S}c"):
                kind, v, f = c.get("t", "n"), c.find(f"{S}v"), c.find(f"{S}f")
                raw = v.text or "" if v is not None else ""
                text, number, flag = None, None, None
                if kind == "s":
                    text = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{S}t"))
                elif kind == "b":
                    flag = raw == "1"
                elif kind in ("str", "e"):
                    text = raw
                elif raw:
                    number = float(raw)
                out.append((path, name.rpartition("/")[2][:-4], c.get("r"), kind, text, number, flag, f.text if f is not None and f.text else None, c.get("s"), None))
    return out


def _read(files: DataFrame, parse, schema: str) -> DataFrame:
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = parse(path, content)
                except Exception as e:  # a damaged file is a row, not a failed job
                    rows = [(path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names).astype({n: "Int32" for n in names if n.endswith("_ix") or n == "depth"})

    return files.select("path", "content").mapInPandas(run, schema)


def read_docx(files: DataFrame) -> DataFrame:
    return _read(files, docx_rows, DOCX_SCHEMA)


def read_xlsx(files: DataFrame) -> DataFrame:
    return _read(files, xlsx_rows, XLSX_SCHEMA)


def docx_text(rows: DataFrame) -> DataFrame:
    """(path, text): non-blank paragraphs, then table rows as ' | '-joined cells; rows of nested tables before their host."""
    paragraphs = rows.where((F.col("kind") == "paragraph") & (python_trim("text") != "")).select("path", F.lit(0).alias("a"), F.col("para_ix").alias("b"), F.lit(0).alias("c"), "text")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("cell_ix", python_trim("text").alias("t")))), lambda x: x["t"])
    lines = rows.where("kind = 'cell'").groupBy("path", "table_ix", "row_ix").agg(cells.alias("cells")).where(F.exists("cells", lambda t: t != ""))
    lines = lines.select("path", F.lit(1).alias("a"), F.col("table_ix").alias("b"), F.col("row_ix").alias("c"), F.array_join("cells", " | ").alias("text"))
    return paragraphs.unionByName(lines).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "c", "text"))), lambda x: x["text"]), "\n").alias("text"))


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def docx_bytes(lines: list[str]) -> bytes:
    """A Word document of paragraphs."""
    paragraphs = "".join("<w:p><w:r>" + '<w:br/>'.join(f'<w:t xml:space="preserve">{_escape(part)}</w:t>' for part in line.split("\n")) + "</w:r></w:p>" for line in lines)
    return _archive({
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{paragraphs}</w:body></w:document>',
    })


def _archive(parts: dict[str, str | bytes]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return held.getvalue()


def written_docx(lines: DataFrame, keys: list[str], order: str = "line_no", text: str = "text") -> DataFrame:
    """(keys, content): one Word document a group of lines; a group's lines are one document's, so they are few."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])

    @F.pandas_udf("binary")
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([docx_bytes([x or "" for x in lines_]) for lines_ in batch])

    return lines.groupBy(*keys).agg(ordered.alias("_l")).select(*keys, build("_l").alias("content"))


def filled_xlsx(content: bytes, written: dict[str, str | float]) -> bytes:
    """A workbook's first sheet with cells replaced or added; styles, member order and all else kept; recalculated on opening."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    name = next(n for n in parts if re.match(r"xl/worksheets/sheet\d*\.xml$", n))
    ET.register_namespace("", S[1:-1])
    root = ET.fromstring(parts[name])
    data = root.find(f"{S}sheetData")
    split = lambda ref: re.match(r"([A-Z]+)(\d+)$", ref).groups()
    place = lambda letters: (len(letters), letters)
    for ref, v in written.items():
        letters, number = split(ref)
        row = next((r for r in data.findall(f"{S}row") if r.get("r") == number), None)
        if row is None:
            row = ET.Element(f"{S}row", {"r": number})
            data.insert(sum(int(r.get("r")) < int(number) for r in data.findall(f"{S}row")), row)
        cell = next((c for c in row.findall(f"{S}c") if c.get("r") == ref), None)
        if cell is None:
            cell = ET.Element(f"{S}c", {"r": ref})
            row.insert(sum(place(split(c.get("r"))[0]) < place(letters) for c in row.findall(f"{S}c")), cell)
        for child in list(cell):
            cell.remove(child)
        if isinstance(v, str):
            cell.set("t", "inlineStr")
            ET.SubElement(ET.SubElement(cell, f"{S}is"), f"{S}t").text = v
        else:
            cell.attrib.pop("t", None)
            ET.SubElement(cell, f"{S}v").text = repr(float(v)).removesuffix(".0")
    parts[name] = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
    if (book := parts.get("xl/workbook.xml")) is not None:
        tree = ET.fromstring(book)
        calc = tree.find(f"{S}calcPr")
        (ET.SubElement(tree, f"{S}calcPr") if calc is None else calc).set("fullCalcOnLoad", "1")
        parts["xl/workbook.xml"] = ET.tostring(tree, xml_declaration=True, encoding="UTF-8")
    return _archive(parts)
