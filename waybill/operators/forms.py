"""Shipping forms as tables of text lines: (shipment_id, form, document, line_no, text).

A form is a projection of shipments, items and batches; lines carry a sort key and are numbered once at the end, inside
each shipment's document. Absent values follow each form's own habit (blank or N/A).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.numbers import amount_words, general, money
from waybill.functions.text import filled, padded
from waybill.operators.rollup import item_batches, item_total, joined_batches, shipment_items, shipment_totals, summed_weights

#: The forms and the documents of each.
FORMS = {"classic": ("invoice", "packing", "coo"), "wide": ("invoice", "packing", "coo"), "germany": ("invoice", "packing", "coo"), "dubai": ("invoice", "packing"), "jordan": ("invoice", "packing")}
# Widths of the padded columns of item lines, by form.
PADS = {"classic": (36, 25, 28), "wide": (58, 32, 24), "germany": (36, 32, 38)}
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£"}


def _or_na(c: Column | str) -> Column:
    return F.when(filled(c) == "", "N/A").otherwise(filled(c))


def headers(shipments: DataFrame) -> DataFrame:
    """One row per shipment with everything the header and footer lines need."""
    items = shipment_items(shipments)
    out = shipments.select("shipment_id", *[filled(c).alias(c) for c in ("invoice_no", "invoice_date", "origin", "total_package_description", "port_of_loading", "port_of_discharge", "port_of_final_destination", "country_of_final_destination", "carriage_by")])
    out = out.join(shipment_totals(shipments), "shipment_id")
    for text, into in (("net_weight_text", "net_total"), ("gross_weight_text", "gross_total"), ("package_count_text", "package_total")):
        out = out.join(summed_weights(items, ["shipment_id"], text, "item_ix", into), "shipment_id", "left").withColumn(into, filled(into))
    packages = F.when(F.col("total_package_description") == "", F.col("package_total")).otherwise(F.col("total_package_description"))
    return out.withColumn("packages", packages).withColumn("origin_upper", F.upper("origin"))


def item_line(form: str) -> Column:
    name, quantity, gap = PADS[form]
    currency = F.when(F.col("currency") == "", "USD").otherwise(F.col("currency"))
    per = F.lit("") if form == "germany" else F.concat(F.lit("/"), F.col("unit"))
    return F.concat(padded("material_name", name), padded("quantity_text", quantity), currency, F.lit(" "), general("unit_price"), per, F.lit(" " * gap), currency, F.lit(" "), money(item_total(F.col("quantity_value"), F.col("unit_price"))))


def date_of_batch() -> Column:
    """Label and value of a batch's date: expiry, else retest, else blank."""
    return F.when(F.col("expiry_date") != "", F.concat(F.lit("Exp. Date: "), F.col("expiry_date"))).when(F.col("retest_date") != "", F.concat(F.lit("Retest Date: "), F.col("retest_date"))).otherwise("Exp. Date: ")


def batch_line(form: str) -> Column:
    no, made, expiry = F.col("batch_no"), F.col("manufacturing_date"), F.col("expiry_date")
    if form == "classic":
        return F.concat(F.lit(" " * 17 + "Batch NO: "), no, F.lit(" " * 13 + "Mfg. Date: "), made, F.lit(" " * 17), date_of_batch())
    if form == "wide":
        return F.concat(F.lit(" " * 19 + "BATCH NO.:   "), no, F.lit(" " * 14 + "MFG. DATE: "), made, F.lit(" " * 10 + "/" + " " * 11 + "EXP. DATE: "), expiry, F.lit(" " * 4))
    return F.concat(F.lit(" " * 11 + "Batch no.:  "), no, F.lit(" " * 15 + "Mfg. Date: "), made, F.lit("   /" + " " * 11 + "Ret. Date: "), expiry)


def _lines(rows: DataFrame, form: str, document: str, sort: list, text: Column) -> DataFrame:
    keys = [(k if isinstance(k, Column) else F.lit(k)).cast("int").alias(f"_s{i}") for i, k in enumerate([*sort, 0, 0, 0][:4])]
    return rows.select("shipment_id", F.lit(form).alias("form"), F.lit(document).alias("document"), *keys, text.alias("text"))


def _header_lines(h: DataFrame, form: str, document: str, at: int, texts: list[Column]) -> DataFrame:
    listed = F.posexplode(F.array(*texts)).alias("_k", "_text")
    return _lines(h.select("shipment_id", listed), form, document, [at, F.col("_k")], F.col("_text"))


def _say() -> Column:
    return amount_words("grand_total", "currency")


def form_lines(shipments: DataFrame, form: str) -> DataFrame:
    """The lines of every document of a form. Null shipment fields count as ''; a shipment without items has its blanks."""
    h = headers(shipments)
    items = shipment_items(shipments)
    real = items.where("real")
    batches = item_batches(real)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    c = F.col
    parts: list[DataFrame] = []
    if form in PADS:
        blank = form == "classic"
        no, date = (c("invoice_no"), c("invoice_date")) if blank else (_or_na("invoice_no"), _or_na("invoice_date"))
        if form == "classic":
            top = [text("No: ", no, " Dated: ", date)]
            end = [text("VALUE TOTAL USD ", money("grand_total")), text("SAY ", _say()), text("Manufacturer ", c("manufacturers")), text("Origin: ", c("origin_upper")), text("(", c("origin_upper"), ")")]
        elif form == "wide":
            top = [text("NO. ", no, " DATE: ", date)]
            end = [text("TOTAL AMOUNT: (", c("currency"), " ", money("grand_total"), ")  SAY ", _say()), text("MANUFACTURER : ", c("manufacturers")), text("ORIGIN : ", c("origin_upper"))]
        else:
            symbol = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in SYMBOLS.items() for v in p]), c("currency")), c("currency"))
            top = [text("Date: ", date), text("INVOICE NO.: ", no)]
            end = [text("TOTAL AMOUNT: (", money("grand_total"), symbol, ")   SAY ", _say()), text("MANUFACTURER: ", c("manufacturers")), text("ORIGIN: ", c("origin_upper")), text("TOTAL NET WIGHT: ", _or_na("net_total")), text("exclusively from ", c("origin_upper"))]
        parts.append(_header_lines(h, form, "invoice", 0, top))
        parts.append(_lines(real, form, "invoice", [1, c("item_ix"), 0] if blank else [1, c("item_ix")], item_line(form)))
        parts.append(_lines(batches, form, "invoice", [1, c("item_ix"), 1, c("batch_ix")] if blank else [2, c("item_ix"), c("batch_ix")], batch_line(form)))
        parts.append(_header_lines(h, form, "invoice", 3, end))
        if form == "classic":
            parts.append(_lines(real, form, "packing", [1, c("item_ix")], text("N/M | ", c("material_name"), "\n\n", c("packaging_description"), "\nGR.WT. ", c("gross_weight_text"), ".\nNT.WT. ", c("net_weight_text"), ".\n")))
            parts.append(_header_lines(h, form, "packing", 2, [text("TOTAL GR. WT ", c("gross_total"), "   -   TOTAL NT.WT. ", c("net_total"), "\nTOTAL ", c("packages"), ".")]))
            parts.append(_header_lines(h, form, "coo", 0, [_or_na("packages"), c("materials"), text("    ", c("origin_upper")), _or_na("net_total"), F.when(c("invoice_no") != "", text(" ", c("invoice_no"), " ")).otherwise(""), c("invoice_date")]))
        else:
            broad = form == "wide"
            labels = ("PRODUCT:" + " " * (31 if broad else 28), "PACKED IN:" + " " * (29 if broad else 27))
            parts.append(_lines(real, form, "packing", [1, c("item_ix"), 0], text(labels[0], c("material_name"))))
            parts.append(_lines(real, form, "packing", [1, c("item_ix"), 1], text(labels[1], c("packaging_description"))))
            parts.append(_header_lines(h, form, "packing", 2, [text("TOTAL NET WIGHT:" + " " * 15, c("net_total")), text("TOTAL GROSS WEIGHT:" + " " * (8 if broad else 7), c("gross_total")), text("TOTAL PACKAGES:" + " " * (17 if broad else 15), c("packages"))]))
            materials = F.when(c("materials") == "N/A", "").otherwise(c("materials"))
            goods = text(c("packages"), " OF ", materials)
            dated = " DATED :" if broad else " DATED:  "
            parts.append(_header_lines(h, form, "coo", 0, [padded(goods, 90) if broad else goods, text("INVOICE NO: ", _or_na("invoice_no"), dated, _or_na("invoice_date")), text("ORIGIN OF THE GOODS IS ", c("origin_upper")), text("MANUFACTURER NAME: " if broad else "", c("manufacturers")), c("origin_upper"), text("       NET: ", c("net_total"), "  " if broad else " ")]))
    elif form == "dubai":
        top = [text("INV No.:   ", _or_na("invoice_no"), "\n\nDATED:  ", _or_na("invoice_date")), _or_na("origin_upper")]
        joined = F.filter(F.coalesce("batches", F.array().cast(dict(items.dtypes)["batches"])), lambda b: b.isNotNull())
        columns = [joined_batches(joined, f) for f in ("batch_no", "manufacturing_date", "expiry_date")] + [c("quantity_text"), c("material_name"), c("quantity_text")]
        currency = F.when(c("currency") == "", "USD").otherwise(c("currency"))
        for document, tail in (("invoice", [text(currency, " ", general("unit_price"), " / ", c("unit")), money(item_total(c("quantity_value"), c("unit_price")))]), ("packing", [c("gross_weight_text"), c("net_weight_text")])):
            parts.append(_header_lines(h, form, document, 0, top))
            parts.append(_lines(real, form, document, [1, c("item_ix")], F.array_join(F.array(*columns, *tail), " | ")))
        parts.append(_header_lines(h, form, "invoice", 2, [text("TOTAL | ", money("grand_total")), text("MANUFACTURED BY: ", c("manufacturers"))]))
        parts.append(_header_lines(h, form, "packing", 2, [text("TOTAL PACKING: ", c("packages"))]))
    elif form == "jordan":
        place = [text("INV No.: ", _or_na("invoice_no")), text("Dated: ", _or_na("invoice_date")), text("Port of Discharge\n", _or_na("port_of_discharge")), text("Port of Final Destination\n", _or_na("port_of_final_destination")), text("Country of Origin :  ", F.upper(_or_na("origin"))), text("Country of Final Destination\n", _or_na("country_of_final_destination")), _or_na("port_of_loading"), _or_na("carriage_by")]
        for document in ("invoice", "packing"):
            parts.append(_header_lines(h, form, document, 0, place))
            number = F.concat((c("item_ix") + 1).cast("string"), F.lit(". "))
            parts.append(_lines(items, form, document, [1, c("item_ix"), 0], F.concat(number, c("material_name"))))
            b = item_batches(items)
            parts.append(_lines(b, form, document, [1, c("item_ix"), 1, c("batch_ix") * 2], text("BATCH No: ", c("batch_no"), " ")))
            parts.append(_lines(b, form, document, [1, c("item_ix"), 1, c("batch_ix") * 2 + 1], text("MFG Date: ", c("manufacturing_date"), "         EXP Date: ", c("expiry_date"))))
            parts.append(_lines(items, form, document, [1, c("item_ix"), 2, 0], text("MANUFACTURED BY: ", _or_na("manufacturer"))))
            weights = text("GR.WT. ", c("gross_weight_text"), "           NT.WT. ", c("net_weight_text"))
            parts.append(_lines(items, form, document, [1, c("item_ix"), 2, 1], weights if document == "invoice" else text("QUANTITY: ", c("quantity_text"), "\n", c("packaging_description"), "\n", weights)))
        currency = F.when(c("currency") == "", "USD").otherwise(c("currency"))
        parts.append(_lines(items, form, "invoice", [1, c("item_ix"), 3], text(c("quantity_text"), " | ", currency, " ", general("unit_price"), "/", c("unit"), " | ", currency, " ", money(item_total(c("quantity_value"), c("unit_price"))))))
        parts.append(_header_lines(h, form, "invoice", 2, [text("SAY: ", _say()), text(c("currency"), " ", money("grand_total")), text("(", c("origin_upper"), ")")]))
        parts.append(_header_lines(h, form, "packing", 2, [text("TOTAL GR.WT. ", c("gross_total"), "-   TOTAL NT.WT. ", c("net_total"), " - TOTAL ", c("packages"))]))
    else:
        raise KeyError(f"no form {form}; forms: {', '.join(FORMS)}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("shipment_id", "document").orderBy("_s0", "_s1", "_s2", "_s3")
    return out.withColumn("line_no", F.row_number().over(w)).select("shipment_id", "form", "document", "line_no", "text")


def form_registry(spark) -> DataFrame:
    """(form, document, available) of every form."""
    return spark.createDataFrame([(f, d, True) for f, ds in FORMS.items() for d in ds], "form string, document string, available boolean")
