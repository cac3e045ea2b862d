"""The SQL of the shipping forms, written from the forms' own descriptions to check their lines by value."""

from __future__ import annotations

from waybill.functions import numbers as N
from waybill.operators.forms import PADS, SYMBOLS
from waybill.plans.reference import _TRIM, _UNITS, ITEMS_SQL


class C(str):
    """An SQL expression among literal texts."""


def cat(*parts: str) -> C:
    return C(" || ".join(p if isinstance(p, C) else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in parts))


def _weights(column: str, into: str) -> str:
    """CTEs that end in ``into`` (shipment_id, t): weights of the items summed per unit."""
    return rf"""{into}_t AS (SELECT shipment_id, item_ix, {_TRIM.format(f"coalesce(item.{column}, '')")} AS t FROM k),
        {into}_p AS (SELECT shipment_id, item_ix, t, try_cast(replace(regexp_extract(t, '^([0-9,]+(?:\.[0-9]+)?)\s*([A-Za-z.]+)', 1), ',', '') AS DOUBLE) AS n, rtrim(rtrim(upper(regexp_extract(t, '^([0-9,]+(?:\.[0-9]+)?)\s*([A-Za-z.]+)', 2)), 'S'), '.') AS u FROM {into}_t WHERE t <> ''),
        {into}_q AS (SELECT *, {_UNITS} AS f, CASE WHEN n IS NULL THEN 2 WHEN {_UNITS} IS NOT NULL THEN 0 ELSE 1 END AS kind FROM {into}_p),
        {into}_g AS (SELECT shipment_id, kind, CASE kind WHEN 0 THEN '' WHEN 1 THEN u ELSE item_ix::VARCHAR END AS grp, sum(CASE kind WHEN 0 THEN n * f ELSE n END) AS v, min(item_ix) AS o, min(t) AS t FROM {into}_q GROUP BY ALL),
        {into}_z AS (SELECT shipment_id, kind, o, CASE kind WHEN 0 THEN CASE WHEN v >= 1000 THEN format('{{:,.2f}} KG', v / 1000) ELSE format('{{:,.2f}} G', v) END WHEN 1 THEN format('{{:,.2f}} ', v) || grp ELSE t END AS x FROM {into}_g),
        {into} AS (SELECT shipment_id, string_agg(x, ' + ' ORDER BY kind, o, x) AS t FROM {into}_z GROUP BY shipment_id)"""


_BLANK = "coalesce(item.{0}, '') AS {0}"
_ITEM_TEXTS = ", ".join(_BLANK.format(c) for c in ("material_name", "manufacturer", "quantity_text", "unit", "packaging_description", "gross_weight_text", "net_weight_text"))
_HEAD_TEXTS = ", ".join(f"coalesce(s.{c}, '') AS {c}" for c in ("invoice_no", "invoice_date", "origin", "port_of_loading", "port_of_discharge", "port_of_final_destination", "country_of_final_destination", "carriage_by"))
_NAMED_ONCE = "coalesce(nullif(array_to_string(list_sort(list(DISTINCT item.{0}) FILTER (item.{0} <> '')), ', '), ''), 'N/A') AS {1}"
_SAID = f"""d AS (SELECT shipment_id, currency, round_even(total, 0)::BIGINT AS n FROM t), ones AS (SELECT {N.ONES!s} AS a, {N.TENS!s} AS b),
    wp AS (SELECT shipment_id, v.k, v.name, CASE v.k WHEN 0 THEN n % 1000 WHEN 1 THEN n // 1000 % 1000 WHEN 2 THEN n // 1000000 % 1000 ELSE n // 1000000000 END AS v FROM d, (VALUES (3, ' BILLION'), (2, ' MILLION'), (1, ' THOUSAND'), (0, '')) v(k, name)),
    ww AS (SELECT shipment_id, k, concat_ws(' ', CASE WHEN v >= 100 THEN a[v // 100 + 1] || ' HUNDRED' END, CASE WHEN v % 100 >= 20 THEN b[v % 100 // 10 + 1] WHEN v % 100 > 0 THEN a[v % 100 + 1] END, CASE WHEN v % 100 >= 20 AND v % 10 > 0 THEN a[v % 10 + 1] END) || name AS x FROM wp, ones WHERE v > 0),
    said AS (SELECT d.shipment_id, coalesce(string_agg(x, ' ' ORDER BY k DESC), 'ZERO') || ' ' || any_value(currency) || ' ONLY.' AS say FROM d LEFT JOIN ww ON d.shipment_id = ww.shipment_id GROUP BY d.shipment_id)"""
BASE = f"""WITH {ITEMS_SQL}, e AS (SELECT s.shipment_id, coalesce(k.item_ix, 0)::INT AS item_ix, k.item FROM s LEFT JOIN k ON s.shipment_id = k.shipment_id),
    {_weights("net_weight_text", "nw")}, {_weights("gross_weight_text", "gw")}, {_weights("package_count_text", "pk")},
    t AS (SELECT shipment_id, coalesce(sum((coalesce(item.quantity_value, 0) * coalesce(item.unit_price, 0))::DECIMAL(30, 6))::DOUBLE, 0) AS total, coalesce(nullif(arg_min(coalesce(item.currency, ''), item_ix), ''), 'USD') AS currency, {_NAMED_ONCE.format("manufacturer", "manufacturers")}, {_NAMED_ONCE.format("material_name", "materials")} FROM e GROUP BY 1),
    {_SAID},
    h AS (SELECT s.shipment_id, {_HEAD_TEXTS}, upper(coalesce(s.origin, '')) AS origin_upper, t.total, t.currency, t.manufacturers, t.materials, said.say, coalesce(nw.t, '') AS net_total, coalesce(gw.t, '') AS gross_total, CASE WHEN coalesce(s.total_package_description, '') = '' THEN coalesce(pk.t, '') ELSE s.total_package_description END AS packages
          FROM s JOIN t ON s.shipment_id = t.shipment_id JOIN said ON s.shipment_id = said.shipment_id LEFT JOIN nw ON s.shipment_id = nw.shipment_id LEFT JOIN gw ON s.shipment_id = gw.shipment_id LEFT JOIN pk ON s.shipment_id = pk.shipment_id),
    fi AS (SELECT shipment_id, item_ix, item IS NOT NULL AS real, {_ITEM_TEXTS}, coalesce(nullif(item.currency, ''), 'USD') AS currency, coalesce(item.unit_price, 0) AS unit_price, coalesce(item.quantity_value, 0) * coalesce(item.unit_price, 0) AS total, list_filter(item.batches, lambda x: x IS NOT NULL) AS bs FROM e),
    fb AS (SELECT shipment_id, item_ix, real, coalesce(ix - 1, 0)::INT AS batch_ix, coalesce(bs[ix].batch_no, '') AS batch_no, coalesce(bs[ix].manufacturing_date, '') AS manufacturing_date, coalesce(bs[ix].expiry_date, '') AS expiry_date, coalesce(bs[ix].retest_date, '') AS retest_date FROM fi, unnest(CASE WHEN len(bs) > 0 THEN generate_series(1, len(bs)) ELSE [NULL::BIGINT] END) u(ix))"""


def money(x: str) -> C:
    return C(rf"CASE WHEN {x} = floor({x}) THEN regexp_replace(format('{{:,.2f}}', {x}), '\.00$', '') ELSE format('{{:,.2f}}', {x}) END")


def _general(x: str) -> C:
    return C(f"format('{{:g}}', {x})")


def _padded(x: str, n: int) -> C:
    return C(f"rpad({x}, greatest(length({x}), {n})::INT, ' ')")


def _na(x: str) -> C:
    return C(f"coalesce(nullif({x}, ''), 'N/A')")


def _bracketed(x: C) -> C:
    return C(f"({x})")


def _all(source: str, document: str, sort: str, text: C, where: str = "true") -> str:
    return f"SELECT shipment_id, '{document}' AS document, {sort}, {text} AS text FROM {source} WHERE {where}"


def _listed(document: str, at: int, texts: list[C]) -> list[str]:
    return [_all("h", document, f"{at} AS s0, {n} AS s1, 0 AS s2, 0 AS s3", t) for n, t in enumerate(texts)]


def form_sql(form: str) -> str:
    c = C
    out: list[str] = []
    if form in PADS:
        name, quantity, gap = PADS[form]
        per = [] if form == "germany" else ["/", c("unit")]
        line = cat(_padded("material_name", name), _padded("quantity_text", quantity), c("currency"), " ", _general("unit_price"), *per, " " * gap, c("currency"), " ", _bracketed(money("total")))
        date = c("(CASE WHEN expiry_date <> '' THEN 'Exp. Date: ' || expiry_date WHEN retest_date <> '' THEN 'Retest Date: ' || retest_date ELSE 'Exp. Date: ' END)")
        batch = {
            "classic": cat(" " * 17 + "Batch NO: ", c("batch_no"), " " * 13 + "Mfg. Date: ", c("manufacturing_date"), " " * 17, date),
            "wide": cat(" " * 19 + "BATCH NO.:   ", c("batch_no"), " " * 14 + "MFG. DATE: ", c("manufacturing_date"), " " * 10 + "/" + " " * 11 + "EXP. DATE: ", c("expiry_date"), " " * 4),
            "germany": cat(" " * 11 + "Batch no.:  ", c("batch_no"), " " * 15 + "Mfg. Date: ", c("manufacturing_date"), "   /" + " " * 11 + "Ret. Date: ", c("expiry_date")),
        }[form]
        total = _bracketed(money("total"))
        if form == "classic":
            out += _listed("invoice", 0, [cat("No: ", c("invoice_no"), " Dated: ", c("invoice_date"))])
            out += _listed("invoice", 3, [cat("VALUE TOTAL USD ", total), cat("SAY ", c("say")), cat("Manufacturer ", c("manufacturers")), cat("Origin: ", c("origin_upper")), cat("(", c("origin_upper"), ")")])
            out += [_all("fi", "packing", "1 AS s0, item_ix AS s1, 0 AS s2, 0 AS s3", cat("N/M | ", c("material_name"), "\n\n", c("packaging_description"), "\nGR.WT. ", c("gross_weight_text"), ".\nNT.WT. ", c("net_weight_text"), ".\n"), "real")]
            out += _listed("packing", 2, [cat("TOTAL GR. WT ", c("gross_total"), "   -   TOTAL NT.WT. ", c("net_total"), "\nTOTAL ", c("packages"), ".")])
            out += _listed("coo", 0, [_na("packages"), c("materials"), cat("    ", c("origin_upper")), _na("net_total"), c("CASE WHEN invoice_no <> '' THEN ' ' || invoice_no || ' ' ELSE '' END"), c("invoice_date")])
        else:
            wide = form == "wide"
            symbol = c("(CASE currency " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYMBOLS.items()) + " ELSE currency END)")
            top = [cat("NO. ", _na("invoice_no"), " DATE: ", _na("invoice_date"))] if wide else [cat("Date: ", _na("invoice_date")), cat("INVOICE NO.: ", _na("invoice_no"))]
            end = [cat("TOTAL AMOUNT: (", c("currency"), " ", total, ")  SAY ", c("say")), cat("MANUFACTURER : ", c("manufacturers")), cat("ORIGIN : ", c("origin_upper"))] if wide else [cat("TOTAL AMOUNT: (", total, symbol, ")   SAY ", c("say")), cat("MANUFACTURER: ", c("manufacturers")), cat("ORIGIN: ", c("origin_upper")), cat("TOTAL NET WIGHT: ", _na("net_total")), cat("exclusively from ", c("origin_upper"))]
            out += _listed("invoice", 0, top) + _listed("invoice", 3, end)
            for k, (label, column) in enumerate((("PRODUCT:" + " " * (31 if wide else 28), "material_name"), ("PACKED IN:" + " " * (29 if wide else 27), "packaging_description"))):
                out.append(_all("fi", "packing", f"1 AS s0, item_ix AS s1, {k} AS s2, 0 AS s3", cat(label, c(column)), "real"))
            out += _listed("packing", 2, [cat("TOTAL NET WIGHT:" + " " * 15, c("net_total")), cat("TOTAL GROSS WEIGHT:" + " " * (8 if wide else 7), c("gross_total")), cat("TOTAL PACKAGES:" + " " * (17 if wide else 15), c("packages"))])
            goods = c("packages || ' OF ' || CASE WHEN materials = 'N/A' THEN '' ELSE materials END")
            out += _listed("coo", 0, [_padded(_bracketed(goods), 90) if wide else goods, cat("INVOICE NO: ", _na("invoice_no"), " DATED :" if wide else " DATED:  ", _na("invoice_date")), cat("ORIGIN OF THE GOODS IS ", c("origin_upper")), cat("MANUFACTURER NAME: " if wide else "", c("manufacturers")), c("origin_upper"), cat("       NET: ", c("net_total"), "  " if wide else " ")])
        out.append(_all("fi", "invoice", "1 AS s0, item_ix AS s1, 0 AS s2, 0 AS s3", line, "real"))
        out.append(_all("fb", "invoice", "1 AS s0, item_ix AS s1, 1 AS s2, batch_ix AS s3" if form == "classic" else "2 AS s0, item_ix AS s1, batch_ix AS s2, 0 AS s3", batch, "real"))
    elif form == "dubai":
        joined = lambda f: c(f"array_to_string(list_filter(list_transform(coalesce(bs, []), lambda x: coalesce(x.{f}, '')), lambda y: y <> ''), ' / ')")
        columns = [joined("batch_no"), " | ", joined("manufacturing_date"), " | ", joined("expiry_date"), " | ", c("quantity_text"), " | ", c("material_name"), " | ", c("quantity_text"), " | "]
        for document, tail in (("invoice", [c("currency"), " ", _general("unit_price"), " / ", c("unit"), " | ", _bracketed(money("total"))]), ("packing", [c("gross_weight_text"), " | ", c("net_weight_text")])):
            out += _listed(document, 0, [cat("INV No.:   ", _na("invoice_no"), "\n\nDATED:  ", _na("invoice_date")), _na("origin_upper")])
            out.append(_all("fi", document, "1 AS s0, item_ix AS s1, 0 AS s2, 0 AS s3", cat(*columns, *tail), "real"))
        out += _listed("invoice", 2, [cat("TOTAL | ", _bracketed(money("total"))), cat("MANUFACTURED BY: ", c("manufacturers"))]) + _listed("packing", 2, [cat("TOTAL PACKING: ", c("packages"))])
    else:
        place = [cat("INV No.: ", _na("invoice_no")), cat("Dated: ", _na("invoice_date")), cat("Port of Discharge\n", _na("port_of_discharge")), cat("Port of Final Destination\n", _na("port_of_final_destination")), cat("Country of Origin :  ", c("upper(coalesce(nullif(origin, ''), 'N/A'))")), cat("Country of Final Destination\n", _na("country_of_final_destination")), _na("port_of_loading"), _na("carriage_by")]
        weights = ["GR.WT. ", c("gross_weight_text"), "           NT.WT. ", c("net_weight_text")]
        at = lambda a, k: f"1 AS s0, item_ix AS s1, {a} AS s2, {k} AS s3"
        for document in ("invoice", "packing"):
            out += _listed(document, 0, place)
            out.append(_all("fi", document, at(0, 0), cat(c("(item_ix + 1)::VARCHAR"), ". ", c("material_name"))))
            out.append(_all("fb", document, at(1, "batch_ix * 2"), cat("BATCH No: ", c("batch_no"), " ")))
            out.append(_all("fb", document, at(1, "batch_ix * 2 + 1"), cat("MFG Date: ", c("manufacturing_date"), "         EXP Date: ", c("expiry_date"))))
            out.append(_all("fi", document, at(2, 0), cat("MANUFACTURED BY: ", _na("manufacturer"))))
            out.append(_all("fi", document, at(2, 1), cat(*weights) if document == "invoice" else cat("QUANTITY: ", c("quantity_text"), "\n", c("packaging_description"), "\n", *weights)))
        out.append(_all("fi", "invoice", at(3, 0), cat(c("quantity_text"), " | ", c("currency"), " ", _general("unit_price"), "/", c("unit"), " | ", c("currency"), " ", _bracketed(money("total")))))
        out += _listed("invoice", 2, [cat("SAY: ", c("say")), cat(c("currency"), " ", _bracketed(money("total"))), cat("(", c("origin_upper"), ")")])
        out += _listed("packing", 2, [cat("TOTAL GR.WT. ", c("gross_total"), "-   TOTAL NT.WT. ", c("net_total"), " - TOTAL ", c("packages"))])
    lines = " UNION ALL ".join(out)
    return f"{BASE}, lines AS ({lines}) SELECT shipment_id, '{form}' AS form, document, row_number() OVER (PARTITION BY shipment_id, document ORDER BY s0, s1, s2, s3)::INT AS line_no, text FROM lines"


ORACLE = {f"ref_form_{f}": form_sql(f) for f in ("classic", "wide", "germany", "dubai", "jordan")}
