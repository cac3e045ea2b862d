import io
import zipfile

from pyspark.sql import functions as F

from waybill.sources import office, templates

BLOCK = "doc_id long, seq int, kind string, text string, font double, heading boolean, centred boolean, rows array<array<string>>"


def shown(content):
    return [(r[1], r[2], r[3], r[4], r[7]) for r in office.docx_rows("x", content)]


def template(spark):
    rows = [["Test", "Limit", "Result"], ["Assay", "98", "old"], ["pH", "5-7", "old"]]
    blocks = [(1, 0, "text", "Certificate", 50.0, True, True, None), (1, 1, "text", "Batch: old", 11.0, False, False, None), (1, 2, "table", None, None, None, None, rows), (1, 3, "text", "a < b & c\nd", None, None, None, None)]
    return templates.written_blocks(spark.createDataFrame([*blocks, (2, 0, "table", None, None, None, None, [["a"], ["b", None]]), (3, 0, "text", None, None, None, None, None)], BLOCK))


def test_documents_of_blocks(spark):
    built = {r["doc_id"]: bytes(r["content"]) for r in template(spark).collect()}
    assert [x[-1] for x in shown(built[1])] == ["Certificate", "Batch: old", "Test", "Limit", "Result", "Assay", "98", "old", "pH", "5-7", "old", "a < b & c\nd"]
    assert [x[-1] for x in shown(built[2])] == ["a", "", "b", ""] and [x[-1] for x in shown(built[3])] == [""]
    xml = zipfile.ZipFile(io.BytesIO(built[1])).read("word/document.xml").decode()
    assert '<w:sz w:val="72"/>' in xml and '<w:jc w:val="center"/>' in xml and "Heading1" in xml and xml.count("<w:b/>") == 4
    assert templates.written_blocks(spark.createDataFrame([], BLOCK)).count() == 0


def test_templates_filled(spark):
    source = template(spark).where("doc_id < 3").unionByName(spark.createDataFrame([(7, bytearray(b"no zip")), (8, None)], "doc_id long, content binary"))
    edits = [
        (1, "paragraph", None, 1, None, ["Batch: B7"], 0), (1, "cell", 0, 1, 2, ["99.1 %"], 0), (1, "delete", 0, 2, None, None, 0), (1, "append", 0, 2, None, ["Water", "1 %"], 1), (1, "append", 0, 2, None, ["Lead", None, "0"], 2),
        (1, "cell", 5, 0, 0, ["nowhere"], 0), (1, "cell", 0, 1, 9, ["nowhere"], 0), (1, "paragraph", None, 2, None, ["a table stands here"], 0), (9, "delete", 0, 0, None, None, 0), (7, "delete", 0, 0, None, None, 0),
    ]
    got = {r["doc_id"]: r for r in templates.fill_templates(source, spark.createDataFrame(edits, "doc_id long, op string, table_ix int, row_ix int, cell_ix int, texts array<string>, seq int")).collect()}
    assert set(got) == {1, 2, 7, 8} and got[1]["error"] is None, got[1]["error"]
    assert [x[-1] for x in shown(bytes(got[1]["content"]))] == ["Certificate", "Batch: B7", "Test", "Limit", "Result", "Assay", "98", "99.1 %", "Water", "1 %", "", "Lead", "", "0", "a < b & c\nd"]
    assert [x[-1] for x in shown(bytes(got[2]["content"]))] == ["a", "", "b", ""] and got[2]["error"] is None
    assert got[7]["content"] is None and "zip" in got[7]["error"] and got[8]["content"] is None and got[8]["error"]


def test_workbooks_filled(spark):
    sheet = f'<worksheet xmlns="{office.S[1:-1]}"><sheetData><row r="8"><c r="B8" s="3" t="s"><v>0</v></c></row></sheetData></worksheet>'
    book = office._archive({"xl/worksheets/sheet1.xml": sheet})
    cells = spark.createDataFrame([(1, "B8", "Aspirin", None), (1, "B9", None, 2.5), (1, "C10", None, None)], "doc_id long, ref string, text string, number double")
    source = spark.createDataFrame([(1, bytearray(book)), (2, bytearray(book)), (3, None)], "doc_id long, content binary")
    got = {r["doc_id"]: r["content"] for r in templates.fill_workbooks(source, cells).collect()}
    rows = {r[2]: (r[4], r[5], r[8]) for r in office.xlsx_rows("x", bytes(got[1]))}
    assert rows == {"B8": ("Aspirin", None, "3"), "B9": (None, 2.5, None), "C10": ("", None, None)}
    assert [r[2] for r in office.xlsx_rows("x", bytes(got[2]))] == ["B8"] and got[3] is None
    assert templates.fill_workbooks(source.limit(0), cells).select(F.count("*")).first()[0] == 0
