import difflib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from waybill.functions import numbers as N
from waybill.functions import text as T
from waybill.operators import compare, forms, keyed, layout, matching, rollup, sheet
from waybill.operators.graph import connected_components
from waybill.sources import documents, office
from waybill.streaming import intake


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.normalize("a"), a=" Date of\tEXPIRY: ") == "date of expiry"
    assert one(spark, T.canonical("a"), a="date of expiry") == "dt exp"
    assert one(spark, T.differs_by_re("a", "b"), a="retest date", b="test date") is True
    assert one(spark, T.differs_by_re("a", "b"), a="test date", b="test date") is False
    assert one(spark, T.bare_label("a"), a="Product Name:  ") == "Product Name"
    assert one(spark, T.bare_label("a"), a="Batch: 7") is None
    assert one(spark, T.known_label("a"), a="BATCH/LOT NO.") == "BATCH/LOT NO"
    assert one(spark, T.shipment_mode("a", "b"), a="", b="CIF Cairo by Sea") == "Air"
    assert one(spark, T.slug("a"), a="Ünal & Co. -") == "nal-co"
    assert one(spark, T.without_group("a", "b"), a="Related substances(HPLC) Impurity A", b="Related substances") == "Impurity A"
    assert one(spark, T.relabel("a", T.EXPIRY_LABEL, "Retest date"), a="Exp. Date: 2024") == "Retest date: 2024"
    assert one(spark, T.relabel("a", T.EXPIRY_LABEL, "Retest date"), a="EXPIRY DATE: 2024") == "RETEST DATE: 2024"
    assert one(spark, T.leading_label("a", "b"), a="Quantity 185.00 KG", b="Quantity") == "185.00 KG"
    assert one(spark, T.garbled("a"), a="YsCˉ1519 " * 8) is True
    assert one(spark, T.holds_run("a", "b"), a="residual solvents", b="residual solvent ethanol") is True
    assert one(spark, T.splice("a", F.lit(2), F.lit(4), F.lit("X")), a="abcdef") == "abXef"
    assert [(f["label"], f["value"]) for f in one(spark, T.line_fields("a"), a="Product Name:   Vonoprazan Fumarate   Batch No: B1")] == [("Product Name", "Vonoprazan Fumarate"), ("Batch No", "B1")]


@pytest.mark.parametrize(("n", "words"), [(30000, "THIRTY THOUSAND USD ONLY."), (0, "ZERO USD ONLY."), (2.5, "TWO USD ONLY."), (-7, "MINUS SEVEN USD ONLY."), (1_200_015, "ONE MILLION TWO HUNDRED THOUSAND FIFTEEN USD ONLY."), (999, "NINE HUNDRED NINETY NINE USD ONLY.")])
def test_amount_words(spark, n, words):
    assert one(spark, N.amount_words(F.lit(float(n)), F.lit("USD"))) == words


def test_number_formats(spark):
    random.seed(3)
    values = [0.0, 2340.0, 2340.5, 0.1, 1e6, 1234567.0, 1e-5, 0.00012, -3.25, 99999.95, *[round(random.uniform(0, 5000), 2) for _ in range(40)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", N.general("v").alias("g"), N.money("v").alias("m")).collect()
    for r in rows:
        assert r["g"] == f"{r['v']:g}", r
        assert r["m"] == (f"{r['v']:,.0f}" if r["v"] == int(r["v"]) else f"{r['v']:,.2f}"), r
    assert one(spark, N.column_number(F.lit("AB"))) == 28
    assert one(spark, N.cleaned_number(F.lit("USD 1,200.50"))) == 1200.5


def reference_match(query, keys):
    """The rules of a label match, written as plain loops over one document."""
    canon = lambda t: sorted(T.SYNONYMS.get(w, w) for w in t.split() if w not in T.STOP_WORDS)
    if not query:
        return None
    if query in keys:
        return query
    q = canon(query)
    for k in keys:
        if q and canon(k) == q:
            return k
    subset = [k for k in keys if q and canon(k) and (set(q) <= set(canon(k)) or set(canon(k)) <= set(q))]
    if len(subset) == 1:
        return subset[0]

    def only_re(a, b):
        pairs = list(zip(a.split(), b.split(), strict=False))
        if len(a.split()) != len(b.split()):
            return False
        other = [(x, y) for x, y in pairs if x != y]
        return bool(other) and all(max(x, y, key=len) == "re" + min(x, y, key=len) for x, y in other)

    for m in difflib.get_close_matches(query, keys, 3, 0.72):
        if not only_re(query, m):
            return m
    best, score = None, 0.0
    for k in keys:
        s = len(set(query.split()) & set(k.split())) / max(1, min(len(set(query.split())), len(set(k.split()))))
        if k and s >= 0.8 and s > score:
            best, score = k, s
    if best:
        return best
    if "qty" in q:
        family = [k for k in keys if "qty" in canon(k)]
        pool = [k for k in family if not set(canon(k)) & set(T.MOLECULAR)] or family
        if len(pool) == 1:
            return pool[0]
    return None


def test_best_match_against_plain_loops(spark):
    random.seed(5)
    labels = ["Batch No", "Lot#", "Retest Date", "Test Date", "Net weight", "Quantity", "Formula Weight", "Mol. wt.", "Date of Manufacture", "Manufacture Date", "Expiry Date", "Exp Date", "Product Name", "Product", "Batch Size", "", "名称", "Certificate No", "Analysis Report Number"]
    docs = {d: [random.choice(labels) for _ in range(random.randint(0, 6))] for d in range(60)}
    fields = spark.createDataFrame([(d, i, x, f"v{i}") for d, xs in docs.items() for i, x in enumerate(xs)], "doc_id long, field_ix int, label string, value string")
    slots = spark.createDataFrame([(d, i, x) for d in docs for i, x in enumerate(labels)], "doc_id long, slot_ix int, label string")
    norm = {x: one(spark, T.normalize(F.lit(x))) for x in labels}
    for r in matching.best_matches(slots, fields).collect():
        keys = list(dict.fromkeys(norm[x] for x in docs[r["doc_id"]]))
        assert r["key"] == reference_match(norm[r["label"]], keys), (r, keys)


def test_four_passes_of_a_header(spark):
    assert one(spark, T.leading_label("a", "b"), a="Batch No 12", b="Batch No.") is None
    assert one(spark, T.leading_label("a", "b"), a=" LOT.  no.:12", b="Lot no.") == "12"
    fields = spark.createDataFrame([(1, i, x, f"v{i}") for i, x in enumerate(["Product", "Product Name", "Quantity", "Net weight", "Grade", "Batch No"])], "doc_id long, field_ix int, label string, value string")
    slots = lambda *rows: spark.createDataFrame([(1, i, x) for i, x in rows], "doc_id long, slot_ix int, label string")
    texts = ["Product Name Aspirin", "Product Name Aspirin tablets", "Quantity 185.00 KG", "Quantity 9", "Batch No 7", "Fax 1", "Product: Name"]
    lines = spark.createDataFrame([(1, i if i < 2 else 2, 10 + i, x) for i, x in enumerate(texts)], "doc_id long, para_ix int, slot_ix int, label string")
    got = matching.fill_slots(slots((0, "Batch No")), slots((20, "Net weight"), (21, "Net wt."), (22, "Quantity"), (23, "Hall")), slots((30, "Grade")), fields, lines)
    assert sorted((r["pass"], r["slot_ix"], r["action"], r["new_value"]) for r in got.collect()) == [
        (1, 0, "fill", "v5"),
        (2, 10, "fill", "v0"), (2, 11, "fill", "v1"), (2, 12, "keep", None), (2, 13, "fill", "v2"), (2, 14, "keep", None), (2, 15, "keep", None), (2, 16, "keep", None),
        (3, 20, "fill", "v3"), (3, 21, "keep", None), (3, 22, "keep", None), (3, 23, "clear", ""),
        (4, 30, "fill", "v4"),
    ]
    assert matching.unused_fields(got, fields).count() == 0


def test_slots_and_unused_fields_are_never_broadcast(spark, sf):
    from waybill.plans import reference

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for query in (reference.ref_slot_actions, reference.ref_unused_fields):
            got = query(spark, sf)
            plan = plan_of(got)
            assert "Broadcast" not in plan
            assert plan.count("Scan parquet") <= 8
        # a document without fields, one without slots, one without lines, lines that share a field over two paragraphs
        fields = spark.createDataFrame([(1, 0, "Grade", "a"), (1, 1, "grade", "b"), (2, 0, "Lot", "c"), (3, 0, "Fax", "d")], "doc_id long, field_ix int, label string, value string")
        slots = lambda *rows: spark.createDataFrame([*rows], "doc_id long, slot_ix int, label string")
        lines = spark.createDataFrame([(1, 0, 5, "Grade x"), (1, 1, 6, "Grade y"), (4, 0, 5, "Lot 3"), (3, 0, 5, "Fax 1")], "doc_id long, para_ix int, slot_ix int, label string")
        got = matching.fill_slots(slots((4, 0, "Lot"), (2, 0, "Lot"), (2, 1, None)), slots((1, 8, "Grade"), (3, 8, "Hall")), slots((3, 9, "Fax")), fields, lines)
        assert sorted((r["doc_id"], r["pass"], r["slot_ix"], r["action"], r["new_value"]) for r in got.collect()) == [
            (1, 2, 5, "fill", "b"), (1, 2, 6, "keep", None), (1, 3, 8, "keep", None),
            (2, 1, 0, "fill", "c"), (2, 1, 1, "clear", ""),
            (3, 2, 5, "fill", "d"), (3, 3, 8, "clear", ""), (3, 4, 9, "fill", "d"),
            (4, 1, 0, "clear", ""), (4, 2, 5, "keep", None),
        ]
        assert matching.fill_slots(slots((2, 0, "Lot")), slots((2, 1, "Lot")), slots((2, 2, "Lot")), fields).where("action = 'keep'").collect()[0]["slot_ix"] == 1
        assert matching.unused_fields(got, fields).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_assigned_best_first(spark):
    rows = spark.createDataFrame([(1, 0, "Assay", ""), (1, 1, "Single impurity", "<0.10%"), (1, 2, "Impurity B", "<0.10%")], "doc_id long, row_ix int, parameter string, specification string")
    items = spark.createDataFrame([(1, 0, "Any individual impurity", "<0.10%"), (1, 1, "Assay (By HPLC, %w/w)", "98 - 102"), (1, 2, "pH", "5 - 7"), (2, 0, None, None)], "doc_id long, item_ix int, parameter string, specification string")
    got = matching.assign_rows(rows, items)
    assert {(r["row_ix"], r["item_ix"]) for r in got.collect()} == {(0, 1), (1, 0)}
    report = matching.fill_report(matching.row_actions(rows, items, got)).where("doc_id = 1").first()
    assert (report["matched"], report["appended"], report["deleted"]) == (2, 1, 1)
    told = items.withColumn("result", F.when(F.col("item_ix") == 1, "99.1 %").otherwise(""))
    actions = matching.row_actions(rows, told, got)
    assert matching.fill_report(actions).where("doc_id = 1").first()["matched"] == 1  # an empty result leaves the row as it was
    texts = {r["row_ix"]: (r["specification"], r["result"]) for r in matching.row_texts(rows.withColumn("result", F.lit("old")), told, actions).where("action = 'match'").collect()}
    assert texts == {0: ("98 - 102", "99.1 %"), 1: ("<0.10%", "old")}


def test_groups_align_by_rank(spark):
    rows = spark.createDataFrame([(1, i, "Related substances", f"Impurity {c}") for i, c in enumerate("BCD")], "doc_id long, row_ix int, parameter string, specification string")
    items = spark.createDataFrame([(1, i, f"Related substance {c}", "<0.1%") for i, c in enumerate("XY")], "doc_id long, item_ix int, parameter string, specification string")
    assert sorted((r["row_ix"], r["item_ix"], r["action"]) for r in matching.align_groups(rows, items).collect()) == [(0, 0, "update"), (1, 1, "update"), (2, None, "delete")]


def test_titled_runs(spark):
    items = spark.createDataFrame([(1, 0, "Amino acids ratio Asp"), (1, 1, "Amino acids ratio Glu"), (1, 2, "pH")], "doc_id long, item_ix int, parameter string")
    assert {r["item_ix"]: r["title"] for r in matching.titled_runs(items).collect()} == {0: "Amino acids ratio", 1: "Amino acids ratio", 2: None}


def test_weights(spark):
    rows = [("a", "12.00 KG", 0), ("a", "500 G", 1), ("b", "100 DRUMS OF 25 KG", 0), ("b", "01 BOX", 1), ("b", "n/a", 2), ("c", None, 0), ("d", ",", 0)]
    out = rollup.summed_weights(spark.createDataFrame(rows, "k string, w string, o int"), ["k"], "w", "o", "total")
    assert {r["k"]: r["total"] for r in out.collect()} == {"a": "12.50 KG", "b": "100.00 DRUM + 1.00 BOX + n/a", "d": ","}


def test_keyed_changes(spark):
    c = spark.createDataFrame([("acme", "Acme", "Acme\nx"), ("acme-2", "Acme", "Acme\ny")], "id string, name string, full_text string")
    added = keyed.insert(c, spark.createDataFrame([("Acme", ""), ("Acme!", None)], "name string, full_text string"))
    assert sorted(r["id"] for r in added.collect()) == ["acme", "acme-2", "acme-3", "acme-4"]
    changed = keyed.update(c, spark.createDataFrame([("acme", "", "new")], "id string, name string, full_text string"))
    assert {r["id"]: (r["name"], r["full_text"]) for r in changed.collect()} == {"acme": ("Acme", "new"), "acme-2": ("Acme", "Acme\ny")}
    assert keyed.delete(c, c.where("id = 'acme'")).count() == 1
    assert keyed.missing(c, spark.createDataFrame([("zzz",)], "id string")).count() == 1
    with pytest.raises(Exception, match="no record"):
        keyed.update(c, spark.createDataFrame([("zzz", "a", "b")], "id string, name string, full_text string")).collect()


def test_sheet(spark):
    s, n = (lambda x: sheet.value("s", txt=F.lit(x))), (lambda x: sheet.value("n", num=F.lit(x)))
    book = spark.range(1).select(s("china").alias("B12"), n(10.0).alias("B9"), n(5.0).alias("B10"), s("").alias("E1"))
    formulas = {"C33": '=IF($B$12="China","CCPIT","CoC")', "C10": "=B9*B10", "D1": "=C10&\" pcs\"", "D2": "=1/0", "D3": "=SUM(B9)", "D4": "=-B9+2*3", "D5": "=IF(B9>5,1)", "D6": "=IF(B9<5,1)", "D7": '=ZZ9&"x"', "F1": "=F2", "F2": "=F1&\"a\""}
    r = sheet.evaluate(book, formulas).first()
    assert (r["C33"]["txt"], r["C10"]["num"], r["D1"]["txt"], r["D2"]["txt"], r["D3"]["txt"], r["D4"]["num"]) == ("CCPIT", 50.0, "50 pcs", "", "", -4.0)
    assert (r["D5"]["num"], r["D6"]["kind"], r["D6"]["num"], r["D7"]["txt"], r["F2"]["txt"]) == (1.0, "b", 0.0, "x", "a" * sheet.PASSES)
    with pytest.raises(sheet.Unsupported):
        sheet.parse("=B9^2")


def test_layout_folds_and_boxes(spark):
    words = spark.createDataFrame([(1, 1, i, f"w{i}", 10.0 * i, 10.0 * i + 8, t, t + 10, 10.0) for i, t in enumerate([0.0, 1.0, 5.5, 20.0, 27.0])], "doc_id long, page int, word_ix long, text string, x0 double, x1 double, top double, bottom double, size double")
    assert [r["line_ix"] for r in layout.anchored_lines(words).orderBy("word_ix").collect()] == [0, 0, 0, 1, 2]
    assert [r["text"] for r in layout.lines(words).orderBy("line_ix").collect()] == ["w0 w1", "w2", "w3", "w4"]
    boxes = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 30.0, 12.0)], "doc_id long, page int, box_ix int, x0 double, top double, x1 double, bottom double")
    assert {r["word_ix"] for r in layout.words_in_boxes(words, boxes).collect()} == {0, 1, 2}
    assert layout.words_outside_boxes(words, boxes).count() == 3
    assert words.agg(layout.upper_median("top").alias("m")).first()["m"] == 5.5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anchored_lines_of_many_batches_without_a_join(spark):
    r = random.Random(3)
    # equal numbers of words, null and NaN sizes and tops, pages longer than an Arrow batch
    odd = lambda x: r.choice([x, x, x, x, x, None, float("nan")])
    rows = [(d, 1, i % 90, f"w{i}", float(i % 7), odd(r.randint(0, 400) / 2), odd(float(r.randint(2, 9)))) for d in range(3) for i in range(100)]
    words = spark.createDataFrame(rows, "doc_id long, page int, word_ix long, text string, x0 double, top double, size double")
    big = lambda x: (x is not None, x != x, 0 if x != x else x or 0)  # noqa: E731  nulls first, NaN last
    want = []
    for d in range(3):
        line, first, largest = -1, None, None
        for row in sorted((x for x in rows if x[0] == d), key=lambda x: (big(x[5]), x[4], x[2], big(x[6]), x[3])):
            top, size = row[5], row[6]
            near = line >= 0 and None not in (top, first, largest) and (largest != largest or top - first <= 0.6 * largest)
            line, first, largest = (line, first, max((largest, size), key=big)) if near else (line + 1, top, size)
            want.append((d, row[3], line))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        got = layout.anchored_lines(words)
        assert got.columns[:4] == ["doc_id", "page", "word_ix", "line_ix"]
        assert sorted((x["doc_id"], x["text"], x["line_ix"]) for x in got.collect()) == sorted(want)
        assert "Join" not in plan_of(got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_forms_have_lines_for_each_shipment(spark, sf):
    s = spark.read.parquet(f"{sf}/shipments.parquet").dropDuplicates(["shipment_id"])
    for form, kinds in forms.FORMS.items():
        lines = forms.form_lines(s, form)
        assert {r["document"] for r in lines.select("document").distinct().collect()} == set(kinds)
        assert lines.select("shipment_id").distinct().count() == s.count()
        assert lines.where("text IS NULL").count() == 0
    with pytest.raises(KeyError):
        forms.form_lines(s, "none")


def test_compare(spark):
    left = spark.createDataFrame([(1, "a", "X-1"), (1, "b", "y"), (1, "c", None)], "pair_id long, field string, value string")
    right = spark.createDataFrame([(1, "a", "x 1"), (1, "c", "z"), (2, "a", "")], "pair_id long, field string, value string")
    got = compare.compare_fields(left, right)
    assert {(r["field"], r["status"]) for r in got.collect()} == {("a", "match"), ("b", "missing_in_right"), ("c", "missing_in_left")}
    assert compare.overall(got).first()["overall_status"] == "match"


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in [*range(40), 99]], "id long")
    edges = spark.createDataFrame([*[(i, i + 1) for i in range(29)], (35, 33), (33, 34), (None, 3), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert {got[i] for i in range(30)} == {0} and {got[i] for i in (33, 34, 35)} == {33} and got[99] == 99 and got[31] == 31
    assert connected_components(nodes.where("id < 0"), edges.where("a < 0")).count() == 0


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(office.docx_bytes(["Product Name: X & Y", "two\nlines", " "]))
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    (tmp_path / "x.png").write_bytes(b"\x89PNG")
    (tmp_path / "x.doc").write_bytes(b"old")
    rows = office.read_docx(office.binary_files(spark, str(tmp_path), "*.docx"))
    assert rows.where("error IS NOT NULL").count() == 1
    docs = {r["filename"]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert docs["a.docx"]["text"] == "Product Name: X & Y\ntwo\nlines"
    assert docs["x.png"]["image_url"].startswith("data:image/png;base64,iVBORw")
    assert documents.unsupported(spark, str(tmp_path)).count() == 1
    raw = documents.rule_extractor(documents.read_documents(spark, str(tmp_path)).where("filename = 'a.docx'"))
    assert documents.typed_answers(raw, "filename").first()["answer"]["header_fields"][0]["value"] == "X & Y"
    sheet_xml = f'<worksheet xmlns="{office.S[1:-1]}"><sheetData><row r="8"><c r="B8" s="3" t="s"><v>0</v></c><c r="C8"><f>B8</f><v>2</v></c></row></sheetData></worksheet>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{office.S[1:-1]}"/>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{office.S[1:-1]}"><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet_xml)
    (tmp_path / "b.xlsx").write_bytes(held.getvalue())
    (tmp_path / "c.xlsx").write_bytes(office.filled_xlsx(held.getvalue(), {"B8": "new", "AA2": 4.0}))
    cells = {(r["path"][-6:], r["ref"]): r for r in office.read_xlsx(office.binary_files(spark, str(tmp_path), "*.xlsx")).collect()}
    assert cells[("b.xlsx", "B8")]["text"] == "ab" and cells[("b.xlsx", "C8")]["formula"] == "B8"
    assert cells[("c.xlsx", "B8")]["text"] == "new" and cells[("c.xlsx", "B8")]["style"] == "3" and cells[("c.xlsx", "AA2")]["number"] == 4.0


def test_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"shipment_id": 1, "items": [{"quantity_value": 2, "unit_price": 3}], "received_at": "2024-01-01T00:00:00Z"}\n{"shipment_id": 1, "received_at": "2024-01-01T01:00:00Z"}\n{"shipment_id": 2, "received_at": "2024-01-02T00:00:00Z"}\n')
    seen = []
    stream = intake.first_deliveries(intake.watch(spark, str(tmp_path / "in")))
    intake.run_batches(stream, lambda df, i: seen.extend(r["shipment_id"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [1, 2]
