"""Queries of the document operators over whole tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import geometry as G
from waybill.functions import numbers as N
from waybill.functions import text as T
from waybill.operators import compare, forms, keyed, layout, matching, rollup, sheet
from waybill.session import read_table

# Header slots of a template, a row of results each.
SLOTS = ("Product Name", "Batch Number", "Mfg Date", "Date of Expiry", "Retest Date", "Net weight", "Test Date", "Lot#", "Formula Weight", "Storage Condition")
# The template's lines without a colon.
TEMPLATE_LINES = ("Quantity 185.00 KG", "Manufacturer  Old Works Ltd", "Country of Origin India", "CAS Number 50-78-2", "Quantity 12 drums", "Grade: USP")
TEMPLATE_ROWS = (("Appearance", "White powder"), ("Identification", "Complies"), ("Related substances", "Impurity B<0.10%"), ("Related substances", "Impurity C<0.10%"), ("Assay", "98.0 - 102.0"), ("Loss on drying", "NMT 0.5%"), ("Residue on ignition", "NMT 0.1%"), ("Heavy metals", "NMT 10 ppm"))
# Formulas of the shipping sheet.
FORMULAS = {"B16": "=$B$8", "B22": "=B12", "A26": "=B14", "C11": "=B9*B10", "A27": '=IF(A6="Air Shipment","AWB:","BL Telex Release:")', "C33": '=IF($B$12="China","CCPIT","CoC")', "B38": '="Origin: "&B12', "D9": "=-(B9+1)/2", "D10": "=SUM(B9)", "D11": "=B8*2"}


def _shipments(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "shipments").drop("received_at").dropDuplicates(["shipment_id"])


def _coa(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "coa_records").drop("received_at").dropDuplicates(["coa_id"])


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "purchase_orders").drop("received_at").dropDuplicates(["po_id"])


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, field_ix, label, value) of the certificates' header fields."""
    return _coa(spark, d).select(F.col("coa_id").alias("doc_id"), F.posexplode("header_fields").alias("field_ix", "f")).where("f IS NOT NULL").select("doc_id", "field_ix", T.filled("f.label").alias("label"), T.filled("f.value").alias("value"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_ix, parameter, specification, result) of the certificates' results."""
    return _coa(spark, d).select(F.col("coa_id").alias("doc_id"), F.posexplode("test_results").alias("item_ix", "t")).where("t IS NOT NULL").select("doc_id", "item_ix", *[T.filled(f"t.{c}").alias(c) for c in ("parameter", "specification", "result")])


def _words(spark: SparkSession, d: str) -> DataFrame:
    """The words of documents set in twelve columns, with a little jitter and a gap every fifth line."""
    ix = F.col("word_ix")
    line = F.floor(ix / 12)
    words = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("word_ix", "text"))
    top = 20 * line + (ix % 3) * 0.5 + F.when(line % 5 == 4, 8).otherwise(0)
    return words.select("doc_id", F.lit(1).alias("page"), "word_ix", "text", (10.0 * (ix % 12)).alias("x0"), (10.0 * (ix % 12) + 8).alias("x1"), top.cast("double").alias("top"), (top + 10).cast("double").alias("bottom"), (10.0 + F.when(line % 7 == 0, 4).otherwise(0)).alias("size"), F.when(line % 7 == 0, "Serif-Bold").otherwise("Serif").alias("fontname"))


WORDS_SQL = """
    w AS (SELECT doc_id, ix - 1 AS word_ix, t[ix] AS text FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL), unnest(generate_series(1, len(t))) u(ix)),
    words AS (SELECT doc_id, 1 AS page, word_ix, text, 10.0::DOUBLE * (word_ix % 12) AS x0, 10.0::DOUBLE * (word_ix % 12) + 8 AS x1,
              (20 * floor(word_ix / 12.0) + (word_ix % 3) * 0.5 + CASE WHEN floor(word_ix / 12.0)::INT % 5 = 4 THEN 8 ELSE 0 END)::DOUBLE AS top,
              (20 * floor(word_ix / 12.0) + (word_ix % 3) * 0.5 + CASE WHEN floor(word_ix / 12.0)::INT % 5 = 4 THEN 8 ELSE 0 END + 10)::DOUBLE AS bottom,
              10.0::DOUBLE + CASE WHEN floor(word_ix / 12.0)::INT % 7 = 0 THEN 4 ELSE 0 END AS size FROM w),
    flagged AS (SELECT *, CASE WHEN abs(top - lag(top) OVER o) > 3 THEN 1 ELSE 0 END AS new FROM words WINDOW o AS (PARTITION BY doc_id, page ORDER BY round(top, 1), x0, word_ix)),
    lined AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY round(top, 1), x0, word_ix ROWS UNBOUNDED PRECEDING) AS line_ix FROM flagged),
    lines AS (SELECT doc_id, page, line_ix, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom, avg(size) AS size, string_agg(text, ' ' ORDER BY x0, word_ix) AS text FROM lined GROUP BY ALL)
"""
SHIPMENTS_SQL = "s AS (SELECT DISTINCT ON (shipment_id) * FROM shipments)"
ITEMS_SQL = f"{SHIPMENTS_SQL}, i AS (SELECT shipment_id, (ix - 1)::INT AS item_ix, items[ix] AS item FROM s, unnest(generate_series(1, len(items))) t(ix) WHERE items[ix] IS NOT NULL), k AS (SELECT shipment_id, (row_number() OVER (PARTITION BY shipment_id ORDER BY item_ix) - 1)::INT AS item_ix, item FROM i)"


def ref_shipment_totals(spark, d):
    t = rollup.shipment_totals(_shipments(spark, d))
    return t.select("shipment_id", "n_items", F.round("grand_total", 2).alias("grand_total"), "currency", "manufacturers", "materials")


def ref_weight_sums(spark, d):
    items = rollup.shipment_items(_shipments(spark, d))
    return rollup.summed_weights(items, ["shipment_id"], "net_weight_text", "item_ix", "net_total")


def ref_item_batches(spark, d):
    return rollup.item_batches(rollup.shipment_items(_shipments(spark, d)).where("real")).select("shipment_id", "item_ix", "batch_ix", "material_name", "batch_no", "expiry_date")


def ref_joined_batches(spark, d):
    items = rollup.shipment_items(_shipments(spark, d)).where("real")
    kept = F.filter("batches", lambda b: b.isNotNull())
    return items.select("shipment_id", "item_ix", F.coalesce(rollup.joined_batches(kept, "batch_no"), F.lit("")).alias("batch_nos"), F.coalesce(rollup.joined_batches(kept, "expiry_date"), F.lit("")).alias("expiries"))


def ref_normalized_labels(spark, d):
    labels = _fields(spark, d).select("label").distinct()
    return labels.select("label", T.normalize("label").alias("normal"), T.canonical(T.normalize("label")).alias("canon"), T.expiry_label(T.normalize("label")).alias("is_expiry"), T.retest_label(T.normalize("label")).alias("is_retest"))


def ref_header_roles(spark, d):
    return _results(spark, d).select("parameter").distinct().select("parameter", F.coalesce(T.header_role("parameter"), F.lit("none")).alias("role"))


def ref_garbled_documents(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.garbled("text").alias("garbled"), T.looks_scanned("text").alias("scanned"))


def ref_shipment_modes(spark, d):
    return _orders(spark, d).groupBy(T.shipment_mode("shipment_mode", "shipping_terms").alias("mode")).agg(F.count("*").alias("n"))


def ref_total_mismatches(spark, d):
    q, p, t = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("quantity", "unit_price", "total_price"))
    return _orders(spark, d).where((t != 0) & (F.abs(t - q * p) > 0.01)).select("po_id", t.alias("stated"), F.round(q * p, 2).alias("computed"))


def ref_customer_ids(spark, d):
    c = read_table(spark, d, "customers").select("id", "name").where("name IS NOT NULL")
    return c.select("id", T.slug("name").alias("slug"), T.file_stem("name").alias("stem"))


def ref_customer_search(spark, d):
    return keyed.search(read_table(spark, d, "customers").select("id", "name").where("name IS NOT NULL"), " Trading ")


def ref_customer_updates(spark, d):
    """Records updated from later orders' spelling, and those deleted that have no usable text."""
    c = read_table(spark, d, "customers").select("id", "name", "full_text").where("name IS NOT NULL AND full_text IS NOT NULL")
    # names of limited companies in capitals; a blank one leaves the name as it is
    changes = c.select("id", F.when(F.contains("name", F.lit("Limited")), F.upper("name")).otherwise("").alias("name"), F.lit("").alias("full_text"))
    gone = c.where(~F.contains("full_text", F.lit("\n"))).select("id")
    return keyed.delete(keyed.update(c, changes), gone)


def ref_amount_words(spark, d):
    return _orders(spark, d).select("po_id", N.amount_words(F.coalesce("total_price", F.lit(0.0)), F.lit("USD")).alias("words"))


def ref_money(spark, d):
    o = _orders(spark, d).fillna(0.0, ["unit_price", "total_price"])
    return o.select("po_id", N.money("total_price").alias("money"), N.general("unit_price").alias("general"))


def ref_lines(spark, d):
    return layout.lines(_words(spark, d)).select("doc_id", "line_ix", "x0", "x1", "top", "bottom", F.round("size", 4).alias("size"), "text")


def ref_paragraphs(spark, d):
    p = layout.paragraphs(layout.lines(_words(spark, d)))
    return p.select("doc_id", "para_ix", "n_lines", "top", "bottom", "bold")


def ref_upper_medians(spark, d):
    return _words(spark, d).groupBy("doc_id").agg(layout.upper_median("size").alias("median_size"), F.count("*").alias("n"))


def _boxes(words: DataFrame) -> DataFrame:
    """A ruled box over the second to fourth line of each page and one over its left margin below."""
    pages = words.select("doc_id", "page").distinct()
    box = F.explode(F.array(*[F.struct(F.lit(i).alias("box_ix"), *[F.lit(float(v)).alias(n) for n, v in zip(("x0", "top", "x1", "bottom"), b, strict=True)]) for i, b in enumerate(((0, 18, 60, 75), (0, 90, 25, 190)))])).alias("b")
    return pages.select("doc_id", "page", box).select("doc_id", "page", "b.*")


def ref_words_in_boxes(spark, d):
    words = _words(spark, d)
    return layout.words_in_boxes(words, _boxes(words)).groupBy("doc_id", "box_ix").agg(F.count("*").alias("n"), F.min("word_ix").alias("first_word"))


def ref_words_outside_boxes(spark, d):
    words = _words(spark, d)
    return layout.words_outside_boxes(words, _boxes(words)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("word_ix").alias("ids"))


def ref_anchored_lines(spark, d):
    words = _words(spark, d).drop("x1", "bottom", "fontname")
    return layout.anchored_lines(words).groupBy("doc_id").agg(F.max("line_ix").alias("last_line"), F.count("*").alias("n"))


def ref_clusters(spark, d):
    """Clusters of the quantities ordered from each vendor."""
    quantities = _orders(spark, d).select("vendor_id", F.coalesce("quantity", F.lit(0.0)).cast("int").alias("x")).distinct()
    return layout.clusters(quantities, ["vendor_id"], "x", 25)


def ref_reading_order(spark, d):
    words = _words(spark, d)
    lines = layout.lines(words).select("doc_id", "page", "top", F.lit("text").alias("kind"))
    boxes = _boxes(words).select("doc_id", "page", "top", F.lit("table").alias("kind"))
    return layout.block_counts(layout.reading_order(lines, boxes))


def ref_signature_images(spark, d):
    """The box of each signature against pictures at the boxes of the same shipment's other certificates."""
    boxed = _coa(spark, d).where("size(signature.bbox) = 4 AND signature.present")
    box = G.clamped_box(*[F.get("signature.bbox", F.lit(i)) for i in range(4)])
    s = boxed.select(F.col("coa_id").alias("doc_id"), F.lit(1).alias("page"), box.alias("box"), "shipment_id").where("box IS NOT NULL")
    pictures = s.select("shipment_id", F.col("doc_id").alias("image_ix"), F.col("box").alias("image_box"))
    images = s.select("doc_id", "page", "shipment_id").join(pictures, "shipment_id").where("doc_id <> image_ix").drop("shipment_id")
    return layout.image_of_box(s.drop("shipment_id"), images).select("doc_id", "image_ix", F.round("score", 6).alias("score"))


def ref_best_matches(spark, d):
    fields = _fields(spark, d)
    slots = fields.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*[F.lit(x) for x in SLOTS])).alias("slot_ix", "label"))
    return matching.best_matches(slots, fields).select("doc_id", "slot_ix", "key", "value", "tier")


def _filled(fields: DataFrame) -> DataFrame:
    """The header slots of a template of all four kinds, filled: with colon, lines without one, bare labels (one twice), known labels."""
    docs = fields.select("doc_id").distinct()
    slots = docs.select("doc_id", F.posexplode(F.array(*[F.lit(x) for x in SLOTS])).alias("slot_ix", "label"))
    lines = docs.select("doc_id", F.posexplode(F.array(*[F.lit(x) for x in TEMPLATE_LINES])).alias("para_ix", "label")).withColumn("slot_ix", F.col("para_ix") + len(SLOTS))
    again = docs.select("doc_id", F.lit(len(SLOTS) + len(TEMPLATE_LINES)).alias("slot_ix"), F.lit("Net wt.").alias("label"))
    return matching.fill_slots(slots.where("slot_ix < 5"), slots.where("slot_ix BETWEEN 5 AND 7").unionByName(again), slots.where("slot_ix > 7"), fields, lines)


def ref_slot_actions(spark, d):
    return _filled(_fields(spark, d))


def ref_unused_fields(spark, d):
    fields = _fields(spark, d)
    return matching.unused_fields(_filled(fields), fields, 2)


def ref_date_actions(spark, d):
    fields = _fields(spark, d)
    # each document's template has the one date or the other, by how many fields the document has
    slots = fields.groupBy("doc_id").agg(F.when(F.count("*") % 2 == 0, "Exp. Date").otherwise("Retest Date").alias("label"))
    return matching.date_action(fields, slots)


def _rows(items: DataFrame) -> DataFrame:
    row = F.posexplode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.lit(s).alias("specification")) for p, s in TEMPLATE_ROWS])).alias("row_ix", "r")
    return items.select("doc_id").distinct().select("doc_id", row).select("doc_id", "row_ix", "r.*")


def ref_assigned_rows(spark, d):
    items = _results(spark, d)
    return matching.assign_rows(_rows(items), items).select("doc_id", "row_ix", "item_ix", F.round("score", 6).alias("score"))


def ref_row_actions(spark, d):
    items = _results(spark, d)
    rows = _rows(items)
    return matching.fill_report(matching.row_actions(rows, items, matching.assign_rows(rows, items)))


def ref_row_groups(spark, d):
    """Runs of results under one label, as a template would hold them."""
    rows = _results(spark, d).withColumnRenamed("item_ix", "row_ix")
    return matching.row_groups(rows).select("doc_id", "row_ix", "param_key", "group_ix", "rank")


def ref_titled_runs(spark, d):
    return matching.titled_runs(_results(spark, d))


def ref_line_fields(spark, d):
    """'label: value' pairs of the certificates' fields set on one line."""
    line = _fields(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_ix", F.concat("label", F.lit(": "), "value").alias("t")))), lambda x: x["t"]), "   ").alias("line"))
    return line.select("doc_id", F.posexplode(T.line_fields("line")).alias("k", "f")).select("doc_id", "k", "f.label", "f.value")


def ref_known_labels(spark, d):
    labels = _fields(spark, d).select("label").distinct()
    return labels.select("label", T.known_label("label").alias("known"), T.bare_label(F.concat("label", F.lit(" :"))).alias("bare"))


def ref_compared_origins(spark, d):
    """Certificates' stated country and maker against their shipments'."""
    coa = _coa(spark, d).where("shipment_id IS NOT NULL").select("coa_id", "shipment_id")
    f = _fields(spark, d).withColumn("field", F.when(T.normalize("label") == "country of origin", "origin").when(T.normalize("label") == "manufacturer", "manufacturer")).where("field IS NOT NULL")
    left = f.join(coa, f["doc_id"] == coa["coa_id"]).select(F.col("coa_id").alias("pair_id"), "field", "value")
    s = _shipments(spark, d).select("shipment_id", "origin", F.get("items", F.lit(0))["manufacturer"].alias("manufacturer")).join(coa, "shipment_id").withColumnRenamed("coa_id", "pair_id")
    return compare.compare_fields(left, compare.unpivot(s, "pair_id", ["origin", "manufacturer"])).groupBy("field", "status").agg(F.count("*").alias("n"))


def ref_sheet_values(spark, d):
    book = sheet.evaluate(sheet.sheet_inputs(_orders(spark, d)), FORMULAS)
    show = lambda r: F.when(F.col(r)["kind"] == "n", F.round(F.col(r)["num"], 4).cast("string")).otherwise(sheet.as_text(F.col(r)))
    return book.select("po_id", *[show(r).alias(r.lower()) for r in ("B16", "B22", "A26", "A27", "C33", "B38", "D10", "D11")], F.round(F.col("C11.num"), 4).alias("c11"), F.round(F.col("D9.num"), 4).alias("d9"))


def ref_fitted_lines(spark, d):
    c = read_table(spark, d, "customers").where("full_text IS NOT NULL")
    return c.select("id", F.array_join(T.fitted(T.text_lines("full_text"), 3), "|").alias("block"))


def _form(name: str):
    def lines(spark, d):
        return forms.form_lines(_shipments(spark, d), name)

    return lines


def ref_cell_upserts(spark, d):
    """Cells of each order's sheet with some overwritten and some added."""
    o = _orders(spark, d).select(F.col("po_id").cast("string").alias("sheet"), "quantity", "product_name")
    cell = lambda ref, v, f: F.struct(F.lit(ref).alias("ref"), v.cast("string").alias("value"), F.lit(f).cast("string").alias("formula"), F.lit("s1").alias("style"))
    cells = o.select("sheet", F.explode(F.array(cell("B8", F.lit(""), None), cell("B9", F.lit("0"), None), cell("C10", F.lit(""), "=B9*B10"))).alias("c")).select("sheet", "c.*")
    written = o.select("sheet", F.explode(F.array(F.struct(F.lit("B8").alias("ref"), T.filled("product_name").alias("value")), F.struct(F.lit("AA12").alias("ref"), F.lit("new").alias("value")))).alias("c")).select("sheet", "c.*")
    return keyed.upsert_cells(cells, written).select("sheet", "ref", "value", "formula", "style", N.cell_row("ref").alias("row"), N.cell_column("ref").alias("col"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("ref_")} | {f"ref_form_{f}": _form(f) for f in forms.FORMS}

_NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_FIELDS = "c AS (SELECT DISTINCT ON (coa_id) * FROM coa_records), f AS (SELECT coa_id AS doc_id, (ix - 1)::INT AS field_ix, coalesce(header_fields[ix].label, '') AS label, coalesce(header_fields[ix].value, '') AS value FROM c, unnest(generate_series(1, len(header_fields))) t(ix) WHERE header_fields[ix] IS NOT NULL)"
_RESULTS = "c AS (SELECT DISTINCT ON (coa_id) * FROM coa_records), r AS (SELECT coa_id AS doc_id, (ix - 1)::INT AS item_ix, coalesce(test_results[ix].parameter, '') AS parameter, coalesce(test_results[ix].specification, '') AS specification FROM c, unnest(generate_series(1, len(test_results))) t(ix) WHERE test_results[ix] IS NOT NULL)"
_ORDERS = "o AS (SELECT DISTINCT ON (po_id) * FROM purchase_orders)"
_SYN = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.SYNONYMS.items()) + " ELSE w END"
_KNOWN = "(?i)^(?:" + "|".join(T.known_label_pattern(p).replace("(?![a-z0-9])", "") for p in sorted(T.KNOWN_LABELS, key=lambda p: -len(p))) + ")$"
_TRIM = r"regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"
_UNITS = "CASE WHEN u IN ('G','GM','GRAM') THEN 1.0 WHEN u = 'KG' THEN 1000.0 WHEN u = 'MG' THEN 0.001 END"

ORACLE = {
    "ref_shipment_totals": f"""WITH {ITEMS_SQL}, one AS (SELECT s.shipment_id, k.item_ix, k.item FROM s LEFT JOIN k ON s.shipment_id = k.shipment_id)
        SELECT shipment_id, count(item) AS n_items, round(sum(coalesce(item.quantity_value, 0) * coalesce(item.unit_price, 0)), 2) AS grand_total,
          coalesce(nullif(coalesce(arg_min(coalesce(item.currency, ''), item_ix), ''), ''), 'USD') AS currency,
          coalesce(nullif(array_to_string(list_sort(list(DISTINCT item.manufacturer) FILTER (item.manufacturer <> '')), ', '), ''), 'N/A') AS manufacturers,
          coalesce(nullif(array_to_string(list_sort(list(DISTINCT item.material_name) FILTER (item.material_name <> '')), ', '), ''), 'N/A') AS materials
        FROM one GROUP BY shipment_id""",
    "ref_weight_sums": rf"""WITH {ITEMS_SQL}, t AS (SELECT shipment_id, item_ix, {_TRIM.format("coalesce(item.net_weight_text, '')")} AS t FROM k),
        p AS (SELECT shipment_id, item_ix, t, try_cast(replace(regexp_extract(t, '^([0-9,]+(?:\.[0-9]+)?)\s*([A-Za-z.]+)', 1), ',', '') AS DOUBLE) AS n,
              rtrim(rtrim(upper(regexp_extract(t, '^([0-9,]+(?:\.[0-9]+)?)\s*([A-Za-z.]+)', 2)), 'S'), '.') AS u FROM t WHERE t <> ''),
        q AS (SELECT *, {_UNITS} AS f, CASE WHEN n IS NULL THEN 2 WHEN {_UNITS} IS NOT NULL THEN 0 ELSE 1 END AS kind FROM p),
        g AS (SELECT shipment_id, kind, CASE kind WHEN 0 THEN '' WHEN 1 THEN u ELSE item_ix::VARCHAR END AS grp, sum(CASE kind WHEN 0 THEN n * f ELSE n END) AS v, min(item_ix) AS o, min(t) AS t FROM q GROUP BY ALL),
        z AS (SELECT shipment_id, kind, o, CASE kind WHEN 0 THEN CASE WHEN v >= 1000 THEN format('{{:,.2f}} KG', v / 1000) ELSE format('{{:,.2f}} G', v) END WHEN 1 THEN format('{{:,.2f}} ', v) || grp ELSE t END AS x FROM g)
        SELECT shipment_id, string_agg(x, ' + ' ORDER BY kind, o, x) AS net_total FROM z GROUP BY shipment_id""",
    "ref_item_batches": f"""WITH {ITEMS_SQL}, b AS (SELECT shipment_id, item_ix, coalesce(item.material_name, '') AS material_name, list_filter(item.batches, lambda x: x IS NOT NULL) AS bs FROM k)
        SELECT shipment_id, item_ix, coalesce(ix - 1, 0)::INT AS batch_ix, material_name, coalesce(bs[ix].batch_no, '') AS batch_no, coalesce(bs[ix].expiry_date, '') AS expiry_date
        FROM b, unnest(CASE WHEN len(bs) > 0 THEN generate_series(1, len(bs)) ELSE [NULL::BIGINT] END) t(ix)""",
    "ref_joined_batches": f"""WITH {ITEMS_SQL} SELECT shipment_id, item_ix,
          coalesce(array_to_string(list_filter(list_transform(item.batches, lambda b: coalesce(b.batch_no, '')), lambda x: x <> ''), ' / '), '') AS batch_nos,
          coalesce(array_to_string(list_filter(list_transform(item.batches, lambda b: coalesce(b.expiry_date, '')), lambda x: x <> ''), ' / '), '') AS expiries FROM k""",
    "ref_normalized_labels": f"""WITH {_FIELDS}, n AS (SELECT DISTINCT label, {_NORM.format("label")} AS normal FROM f)
        SELECT label, normal, coalesce(array_to_string(list_sort(list_transform(list_filter(string_split(normal, ' '), lambda w: w <> '' AND w NOT IN ('of', 'the', 'a', 'an')), lambda w: {_SYN})), ' '), '') AS canon,
          list_contains(string_split(normal, ' '), 'date') AND list_has_any(string_split(normal, ' '), ['exp', 'expiry', 'expiration']) AS is_expiry,
          list_contains(string_split(normal, ' '), 'date') AND regexp_matches(replace(normal, ' ', ''), '{"|".join(T.RETEST_WORDS)}') AS is_retest FROM n""",
    "ref_header_roles": f"""WITH {_RESULTS}, n AS (SELECT DISTINCT parameter, {_NORM.format("parameter")} AS x FROM r)
        SELECT parameter, CASE {" ".join(f"WHEN {' OR '.join(f'contains(x, {chr(39)}{k}{chr(39)})' for k in keys)} THEN '{role}'" for role, keys in T.ROLES)} ELSE 'none' END AS role FROM n""",
    "ref_garbled_documents": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+'), lambda x: x <> '') AS ts FROM documents),
        m AS (SELECT doc_id, text, len(list_filter(ts, lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(regexp_replace(x, '[\x00-\x7F]', '', 'g'), '\p{L}'))) AS mixed, len(list_filter(ts, lambda x: regexp_matches(x, '\p{L}'))) AS checked FROM t)
        SELECT doc_id, length(text) >= 50 AND (mixed >= 5 OR checked > 20 AND mixed > 0.08 * checked) AS garbled, length(trim(text, E' \n\t')) < 20 AS scanned FROM m""",
    "ref_shipment_modes": f"""WITH {_ORDERS}, x AS (SELECT lower(coalesce(shipment_mode, '') || ' ' || coalesce(shipping_terms, '')) AS x FROM o)
        SELECT CASE WHEN contains(x, 'air') THEN 'Air' WHEN regexp_matches(x, 'sea|ocean|vessel|fcl|lcl') THEN 'Sea' ELSE '' END AS mode, count(*) AS n FROM x GROUP BY 1""",
    "ref_total_mismatches": f"""WITH {_ORDERS} SELECT po_id, total_price AS stated, round(coalesce(quantity, 0) * coalesce(unit_price, 0), 2) AS computed FROM o WHERE coalesce(total_price, 0) <> 0 AND abs(total_price - coalesce(quantity, 0) * coalesce(unit_price, 0)) > 0.01""",
    "ref_customer_ids": r"""SELECT id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), ''), 'customer') AS slug, coalesce(nullif(regexp_replace(trim(name, E' \t\n'), '[^A-Za-z0-9 _-]', '', 'g'), ''), 'Product') AS stem FROM customers WHERE name IS NOT NULL""",
    "ref_customer_search": "SELECT id, name FROM customers WHERE contains(lower(name), 'trading')",
    "ref_customer_updates": r"""SELECT id, trim(CASE WHEN contains(name, 'Limited') THEN upper(name) ELSE name END, E' \t\n') AS name, trim(full_text, E' \t\n') AS full_text FROM customers WHERE name IS NOT NULL AND full_text IS NOT NULL AND contains(full_text, E'\n')""",
    "ref_money": rf"""WITH {_ORDERS.replace("* FROM", "po_id, coalesce(total_price, 0) AS total_price, coalesce(unit_price, 0) AS unit_price FROM")} SELECT po_id, CASE WHEN total_price = floor(total_price) THEN regexp_replace(format('{{:,.2f}}', total_price), '\.00$', '') ELSE format('{{:,.2f}}', total_price) END AS money, format('{{:g}}', unit_price) AS general FROM o""",
    "ref_amount_words": rf"""WITH {_ORDERS}, d AS (SELECT po_id, round_even(coalesce(total_price, 0), 0)::BIGINT AS n FROM o),
        ones AS (SELECT {str(N.ONES)} AS a, {str(N.TENS)} AS b),
        p AS (SELECT po_id, n, s.k, s.name, CASE s.k WHEN 0 THEN n % 1000 WHEN 1 THEN n // 1000 % 1000 WHEN 2 THEN n // 1000000 % 1000 ELSE n // 1000000000 END AS v FROM d, (VALUES (3, ' BILLION'), (2, ' MILLION'), (1, ' THOUSAND'), (0, '')) s(k, name)),
        w AS (SELECT po_id, n, k, concat_ws(' ', CASE WHEN v >= 100 THEN a[v // 100 + 1] || ' HUNDRED' END, CASE WHEN v % 100 >= 20 THEN b[v % 100 // 10 + 1] WHEN v % 100 > 0 THEN a[v % 100 + 1] END, CASE WHEN v % 100 >= 20 AND v % 10 > 0 THEN a[v % 10 + 1] END) || name AS x FROM p, ones WHERE v > 0)
        SELECT d.po_id, coalesce(string_agg(x, ' ' ORDER BY k DESC), 'ZERO') || ' USD ONLY.' AS words FROM d LEFT JOIN w ON d.po_id = w.po_id GROUP BY d.po_id""",
    "ref_lines": f"WITH {WORDS_SQL} SELECT doc_id, line_ix::BIGINT AS line_ix, x0, x1, top, bottom, round(size, 4) AS size, text FROM lines",
    "ref_paragraphs": f"""WITH {WORDS_SQL},
        f AS (SELECT *, size > 11 AS bold, CASE WHEN top - lag(bottom) OVER o > 0.9 * greatest(lag(bottom) OVER o - lag(top) OVER o, 1) OR abs(size - lag(size) OVER o) > 2 THEN 1 ELSE 0 END AS new FROM lines WINDOW o AS (PARTITION BY doc_id, page ORDER BY line_ix)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY line_ix ROWS UNBOUNDED PRECEDING) AS para_ix FROM f)
        SELECT doc_id, para_ix::BIGINT AS para_ix, count(*) AS n_lines, min(top) AS top, max(bottom) AS bottom, 2 * count(*) FILTER (bold) >= count(*) AS bold FROM g GROUP BY doc_id, page, para_ix""",
    "ref_upper_medians": f"WITH {WORDS_SQL} SELECT doc_id, list_sort(list(size))[count(*) // 2 + 1] AS median_size, count(*) AS n FROM words GROUP BY doc_id",
    "ref_words_in_boxes": f"""WITH {WORDS_SQL}, b AS (SELECT * FROM (VALUES (0, 0.0, 18.0, 60.0, 75.0), (1, 0.0, 90.0, 25.0, 190.0)) b(box_ix, bx0, btop, bx1, bbottom))
        SELECT doc_id, box_ix, count(*) AS n, min(word_ix)::INT AS first_word FROM words, b WHERE (x0 + x1) / 2 BETWEEN bx0 AND bx1 AND (top + bottom) / 2 BETWEEN btop AND bbottom GROUP BY ALL""",
    "ref_words_outside_boxes": f"""WITH {WORDS_SQL}, b AS (SELECT * FROM (VALUES (0.0, 18.0, 60.0, 75.0), (0.0, 90.0, 25.0, 190.0)) b(bx0, btop, bx1, bbottom))
        SELECT doc_id, count(*) AS n, sum(word_ix)::BIGINT AS ids FROM words WHERE NOT EXISTS (SELECT 1 FROM b WHERE x0 >= bx0 - 1 AND x1 <= bx1 + 1 AND top >= btop - 1 AND bottom <= bbottom + 1) GROUP BY doc_id""",
    "ref_clusters": f"""WITH {_ORDERS}, x AS (SELECT DISTINCT vendor_id, trunc(coalesce(quantity, 0))::INT AS x FROM o),
        f AS (SELECT *, CASE WHEN x - lag(x) OVER w > 25 THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY vendor_id ORDER BY x)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY vendor_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS cluster_ix FROM f)
        SELECT vendor_id, cluster_ix::BIGINT AS cluster_ix, trunc(avg(x))::INT AS centre, count(*) AS n FROM g GROUP BY vendor_id, cluster_ix""",
    "ref_reading_order": f"""WITH {WORDS_SQL} SELECT doc_id, count(*) AS n_text, 2::BIGINT AS n_table, 0::BIGINT AS n_image FROM lines GROUP BY doc_id""",
    "ref_signature_images": f"""WITH c AS (SELECT DISTINCT ON (coa_id) * FROM coa_records), q AS (SELECT coa_id, shipment_id, list_transform(signature.bbox, lambda v: greatest(0, least(1, v))) AS b FROM c WHERE signature.present AND len(signature.bbox) = 4),
        s AS (SELECT coa_id, shipment_id, least(b[1], b[3]) AS x0, greatest(b[1], b[3]) AS x1, least(b[2], b[4]) AS y0, greatest(b[2], b[4]) AS y1 FROM q),
        k AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM s WHERE x1 - x0 >= 0.005 AND y1 - y0 >= 0.005),
        p AS (SELECT a.coa_id AS doc_id, i.coa_id AS image_ix, greatest(0, least(a.x1, i.x1) - greatest(a.x0, i.x0)) * greatest(0, least(a.y1, i.y1) - greatest(a.y0, i.y0)) / least(a.area, i.area) AS c, sqrt(((a.x0 + a.x1 - i.x0 - i.x1) / 2) ** 2 + ((a.y0 + a.y1 - i.y0 - i.y1) / 2) ** 2) AS d FROM k a JOIN k i ON a.shipment_id = i.shipment_id AND a.coa_id <> i.coa_id WHERE i.area > 0 AND i.area <= 0.5),
        z AS (SELECT *, CASE WHEN c >= 0.3 THEN c WHEN d <= 0.08 THEN 0.3 - d END AS score FROM p)
        SELECT doc_id, image_ix, round(score, 6) AS score FROM z WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, image_ix) = 1""",
    "ref_row_groups": rf"""WITH {_RESULTS}, k AS (SELECT doc_id, item_ix AS row_ix, {_NORM.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(parameter, '\bany\s+(?:single\s+|one\s+)?individual\s+impurity\b', 'single impurity', 'gi'), '\bany\s+single\s+impurity\b', 'single impurity', 'gi'), '\bmax(?:imum)?\s+individual\s+impurity\b', 'single impurity', 'gi'), '\blargest\s+(?:single\s+|individual\s+)?impurity\b', 'single impurity', 'gi')")} AS param_key FROM r),
        f AS (SELECT *, CASE WHEN param_key = lag(param_key) OVER w THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY row_ix)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY row_ix ROWS UNBOUNDED PRECEDING) AS run FROM f),
        h AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM g)
        SELECT doc_id, row_ix, param_key, dense_rank() OVER (PARTITION BY doc_id ORDER BY run)::INT AS group_ix, row_number() OVER (PARTITION BY doc_id, run ORDER BY row_ix)::INT AS rank FROM h WHERE n >= 2 AND param_key <> ''""",
    "ref_date_actions": f"""WITH {_FIELDS}, n AS (SELECT doc_id, string_split({_NORM.format("label")}, ' ') AS w, value FROM f),
        s AS (SELECT doc_id, bool_or(list_contains(w, 'date') AND list_has_any(w, ['exp', 'expiry', 'expiration'])) AS e, bool_or(list_contains(w, 'date') AND regexp_matches(array_to_string(w, ''), '{"|".join(T.RETEST_WORDS)}')) AS r FROM n WHERE trim(value) <> '' GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) % 2 = 0 AS te, count(*) % 2 = 1 AS tr FROM f GROUP BY doc_id),
        j AS (SELECT doc_id, coalesce(e, false) AS e, coalesce(r, false) AS r, coalesce(te, false) AS te, coalesce(tr, false) AS tr FROM s FULL JOIN t USING (doc_id))
        SELECT doc_id, CASE WHEN e AND NOT r AND NOT te THEN 'retest_to_expiry' WHEN NOT e AND r AND tr THEN 'rename_source' WHEN NOT e AND r THEN 'expiry_to_retest' ELSE 'none' END AS action FROM j""",
    "ref_compared_origins": f"""WITH {_FIELDS}, {SHIPMENTS_SQL}, l AS (SELECT doc_id, CASE {_NORM.format("label")} WHEN 'country of origin' THEN 'origin' WHEN 'manufacturer' THEN 'manufacturer' END AS field, min(CASE WHEN trim(f.value) <> '' THEN f.value END) AS lv FROM f JOIN c ON c.coa_id = f.doc_id AND c.shipment_id IS NOT NULL GROUP BY 1, 2 HAVING field IS NOT NULL),
        r AS (SELECT coa_id AS doc_id, 'origin' AS field, CASE WHEN trim(origin) <> '' THEN origin END AS rv FROM c JOIN s USING (shipment_id) UNION ALL SELECT coa_id, 'manufacturer', CASE WHEN trim(items[1].manufacturer) <> '' THEN items[1].manufacturer END FROM c JOIN s USING (shipment_id))
        SELECT field, CASE WHEN lv IS NULL THEN 'missing_in_left' WHEN rv IS NULL THEN 'missing_in_right' WHEN {_NORM.format("lv")} = {_NORM.format("rv")} THEN 'match' ELSE 'mismatch' END AS status, count(*) AS n FROM l FULL JOIN r USING (doc_id, field) WHERE lv IS NOT NULL OR rv IS NOT NULL GROUP BY 1, 2""",
    "ref_sheet_values": f"""WITH {_ORDERS}, x AS (SELECT po_id, {_TRIM.format("coalesce(product_name, '')")} AS p, {_TRIM.format("coalesce(origin_country, '')")} AS c, coalesce(quantity, 0) AS q, coalesce(unit_price, 0) AS u, lower({_TRIM.format("coalesce(shipment_mode, '')")}) AS m FROM o)
        SELECT po_id, p AS b16, c AS b22, 'full' AS a26, CASE WHEN m LIKE 'sea%' THEN 'BL Telex Release:' ELSE 'AWB:' END AS a27, CASE WHEN lower(trim(c)) = 'china' THEN 'CCPIT' ELSE 'CoC' END AS c33, 'Origin: ' || c AS b38, '' AS d10,
          CASE WHEN replace(p, ',', '') = '' THEN '0.0' ELSE coalesce(round(try_cast(replace(p, ',', '') AS DOUBLE) * 2, 4)::VARCHAR, '') END AS d11, round(q * u, 4) AS c11, round(-(q + 1) / 2, 4) AS d9 FROM x""",
    "ref_known_labels": rf"""WITH {_FIELDS}, l AS (SELECT DISTINCT label, {_TRIM.format("label")} AS t FROM f), k AS (SELECT label, t, {_TRIM.format(r"regexp_replace(t, '[.\-]+$', '')")} AS x FROM l)
        SELECT label, CASE WHEN x <> '' AND NOT regexp_matches(x, '[:：]') AND length(x) <= 45 AND regexp_matches(x, '{_KNOWN}') THEN x END AS known, CASE WHEN NOT regexp_matches(label, '[:：]') AND length(t) BETWEEN 1 AND 60 THEN t END AS bare FROM k""",
    "ref_fitted_lines": rf"""WITH l AS (SELECT id, list_filter(list_transform(string_split(full_text, E'\n'), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS l FROM customers WHERE full_text IS NOT NULL)
        SELECT id, CASE WHEN len(l) <= 3 THEN array_to_string(list_resize(l, 3, ''), '|') ELSE l[1] || '|' || l[2] || '|' || array_to_string(l[3:], ', ') END AS block FROM l""",
    "ref_cell_upserts": f"""WITH {_ORDERS} SELECT po_id::VARCHAR AS sheet, ref, CASE ref WHEN 'B8' THEN coalesce(product_name, '') WHEN 'B9' THEN '0' WHEN 'C10' THEN '' ELSE 'new' END AS value, CASE ref WHEN 'C10' THEN '=B9*B10' END AS formula, CASE WHEN ref <> 'AA12' THEN 's1' END AS style, CASE ref WHEN 'B8' THEN 8 WHEN 'B9' THEN 9 WHEN 'C10' THEN 10 ELSE 12 END AS row, CASE ref WHEN 'C10' THEN 3 WHEN 'AA12' THEN 27 ELSE 2 END AS col
        FROM o, (VALUES ('B8'), ('B9'), ('C10'), ('AA12')) r(ref)""",
}
