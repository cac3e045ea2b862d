"""Word templates filled and documents built from blocks, a document a row, in Arrow batches.

Tables and paragraphs of a template are counted as :func:`waybill.sources.office.docx_rows` counts them, so the places in
its rows are the places to write to.
"""

from __future__ import annotations

import copy
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.sources.office import W, _archive, _escape, docx_bytes, filled_xlsx

EDIT = "struct<op: string, table_ix: int, row_ix: int, cell_ix: int, texts: array<string>>"
OPS = ("paragraph", "cell", "append", "delete")


def _tables(body: ET.Element) -> list[ET.Element]:
    """The tables in the order in which they are numbered: a host before the tables in its cells."""
    out: list[ET.Element] = []

    def add(table: ET.Element) -> None:
        out.append(table)
        for row in table.findall(f"{W}tr"):
            for cell in row.findall(f"{W}tc"):
                for nested in cell.findall(f"{W}tbl"):
                    add(nested)

    for element in body:
        if element.tag == f"{W}tbl":
            add(element)
    return out


def _write(paragraph: ET.Element, text: str) -> None:
    """One run with the first run's properties holds the text; line ends become breaks."""
    runs = paragraph.findall(f"{W}r")
    style = runs[0].find(f"{W}rPr") if runs else None
    for child in list(paragraph):
        if child.tag != f"{W}pPr":
            paragraph.remove(child)
    run = ET.SubElement(paragraph, f"{W}r")
    if style is not None:
        run.append(style)
    for k, line in enumerate(text.split("\n")):
        if k:
            ET.SubElement(run, f"{W}br")
        t = ET.SubElement(run, f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
        t.text = line


def _write_cell(cell: ET.Element, text: str) -> None:
    paragraphs = cell.findall(f"{W}p")
    for p in paragraphs[1:]:
        cell.remove(p)
    _write(paragraphs[0] if paragraphs else ET.SubElement(cell, f"{W}p"), text)


def _place(x) -> int:
    """A place as an int; Arrow hands nested integers beside nulls over as floats."""
    return -1 if x is None or x != x else int(x)


def filled_docx(content: bytes, edits: list[dict]) -> bytes:
    """A template with its edits made; all parts but the document's own stay byte by byte.

    ``paragraph``: the body's paragraph ``row_ix`` gets the first text. ``cell``: a cell gets it. ``append``: a copy of row
    ``row_ix`` goes behind it and behind earlier copies, its cells hold the texts, further cells are blank. ``delete``: the
    row goes. Places are those of the template before any edit; edits of places that aren't there are left out.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(parts["word/document.xml"]), events=["start-ns"]):
        if not prefix.startswith("ns"):
            ET.register_namespace(prefix, uri)
    root = ET.fromstring(parts["word/document.xml"])
    body = root.find(f"{W}body")
    elements = list(body)
    tables = _tables(body)
    rows = [list(t.findall(f"{W}tr")) for t in tables]
    behind: dict[tuple[int, int], ET.Element] = {}
    for edit in sorted(edits, key=lambda e: OPS.index(e["op"])):
        texts, r = list(edit["texts"] if edit["texts"] is not None else []), _place(edit["row_ix"])
        if edit["op"] == "paragraph":
            if 0 <= r < len(elements) and elements[r].tag == f"{W}p":
                _write(elements[r], (texts[0] if texts else "") or "")
            continue
        k, c = _place(edit["table_ix"]), _place(edit["cell_ix"])
        if not (0 <= k < len(tables) and 0 <= r < len(rows[k])):
            continue
        row = rows[k][r]
        if edit["op"] == "cell":
            cells = row.findall(f"{W}tc")
            if 0 <= c < len(cells):
                _write_cell(cells[c], (texts[0] if texts else "") or "")
        elif edit["op"] == "append":
            new = copy.deepcopy(row)
            for n, cell in enumerate(new.findall(f"{W}tc")):
                for merge in cell.findall(f"{W}tcPr/{W}vMerge"):
                    cell.find(f"{W}tcPr").remove(merge)
                _write_cell(cell, (texts[n] if n < len(texts) else "") or "")
            at = list(tables[k]).index(behind.get((k, r), row))
            tables[k].insert(at + 1, new)
            behind[(k, r)] = new
        elif row in list(tables[k]):
            tables[k].remove(row)
    parts["word/document.xml"] = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
    return _archive(parts)


def fill_templates(templates: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content, error): every template (key, content) with its edits (key, op, table_ix, row_ix, cell_ix, texts) made.

    A template without edits comes out as it is; null content or a damaged file gives null content and an error; edits
    without a template are left out. One exchange on the key; a document's edits are few. Rows to append are in the order
    of ``seq``, where edits have one.
    """
    seq = F.col("seq") if "seq" in edits.columns else F.lit(0)
    listed = edits.where(F.col("op").isin(*OPS)).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("seq"), "table_ix", "row_ix", "cell_ix", "op", "texts"))), lambda e: F.struct(e["op"].alias("op"), e["table_ix"].cast("int").alias("table_ix"), e["row_ix"].cast("int").alias("row_ix"), e["cell_ix"].cast("int").alias("cell_ix"), e["texts"].alias("texts"))).alias("_edits"))

    @F.pandas_udf("struct<content: binary, error: string>")
    def build(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, all_edits in batches:
            out = []
            for content, own in zip(contents, all_edits, strict=True):
                try:
                    out.append((bytes(content) if own is None or not len(own) else filled_docx(bytes(content), list(own)), None))
                except Exception as e:  # a damaged file is a row, not a failed job
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["content", "error"])

    return templates.join(listed, key, "left").select(key, build("content", "_edits").alias("_b")).select(key, "_b.content", "_b.error")


def fill_workbooks(templates: DataFrame, cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content): every workbook (key, content) with its cells (key, ref, text, number) written, the number where there is one."""
    listed = cells.groupBy(key).agg(F.collect_list(F.struct("ref", "text", "number")).alias("_cells"))

    @F.pandas_udf("binary")
    def build(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, all_cells in batches:
            yield pd.Series([None if c is None else filled_xlsx(bytes(c), {x["ref"]: x["number"] if x["number"] is not None and x["number"] == x["number"] else x["text"] or "" for x in (own if own is not None else [])}) for c, own in zip(contents, all_cells, strict=True)])

    return templates.join(listed, key, "left").select(key, build("content", "_cells").alias("content"))


def blocks_docx(blocks: list[dict]) -> bytes:
    """A document of blocks in order: ``text`` with font size, heading and centring, ``table`` with rows of cells, the first in bold."""

    def run(text: str, size: float | None, bold: bool) -> str:
        style = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{round(2 * max(8.0, min(size, 36.0)))}"/>' if size else "")
        lines = "<w:br/>".join(f'<w:t xml:space="preserve">{_escape(line)}</w:t>' for line in (text or "").split("\n"))
        return f"<w:r>{f'<w:rPr>{style}</w:rPr>' if style else ''}{lines}</w:r>"

    out = []
    for b in blocks:
        if b["kind"] == "table":
            rows = [list(r) for r in (b["rows"] if b["rows"] is not None else [])]
            width = max((len(r) for r in rows), default=0)
            cells = lambda r, bold: "".join(f"<w:tc><w:p>{run(x or '', None, bold)}</w:p></w:tc>" for x in [*r, *[""] * (width - len(r))])
            out.append("<w:tbl>" + "".join(f"<w:tr>{cells(r, k == 0)}</w:tr>" for k, r in enumerate(rows)) + "</w:tbl>")
        else:
            centred, heading = bool(b.get("centred")), bool(b.get("heading"))
            style = ('<w:pStyle w:val="Heading1"/>' if heading else "") + ('<w:jc w:val="center"/>' if centred else "")
            out.append(f"<w:p>{f'<w:pPr>{style}</w:pPr>' if style else ''}{run(b['text'], b.get('font'), heading)}</w:p>")
    plain = docx_bytes([])
    with zipfile.ZipFile(io.BytesIO(plain)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["word/document.xml"] = parts["word/document.xml"].replace(b"<w:body>", b"<w:body>" + "".join(out).encode())
    return _archive(parts)


def written_blocks(blocks: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """(key, content): a document for each key's blocks (kind, text, font, heading, centred, rows), in order."""
    fields = ["kind", "text", "font", "heading", "centred", "rows"]
    listed = F.array_sort(F.collect_list(F.struct(order, *fields)))

    @F.pandas_udf("binary")
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([blocks_docx([dict(b) for b in own]) for own in batch])

    return blocks.groupBy(key).agg(F.transform(listed, lambda b: F.struct(*[b[f].alias(f) for f in fields])).alias("_b")).select(key, build("_b").alias("content"))
