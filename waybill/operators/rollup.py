"""Shipments to items and batches, and their totals. One exchange at most, on the shipment's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.text import filled
from waybill.session import python_trim

# Grams of the mass units, by the unit's text without a plural.
GRAMS = {"MG": 0.001, "G": 1.0, "GM": 1.0, "GRAM": 1.0, "KG": 1000.0}
WEIGHT = r"^([0-9,]+(?:\.[0-9]+)?)\s*([A-Za-z.]+)"
ITEM_TEXTS = ("material_name", "manufacturer", "quantity_text", "unit", "currency", "packaging_description", "package_count_text", "gross_weight_text", "net_weight_text")
BATCH_TEXTS = ("batch_no", "manufacturing_date", "expiry_date", "retest_date")


def item_total(quantity: Column, price: Column) -> Column:
    return F.coalesce(quantity, F.lit(0.0)) * F.coalesce(price, F.lit(0.0))


def shipment_items(shipments: DataFrame) -> DataFrame:
    """One row per item, with its place; a shipment without items has one row of blanks. Null elements are left out."""
    kept = F.filter("items", lambda i: i.isNotNull())
    rows = shipments.select("shipment_id", F.posexplode_outer(F.transform(kept, lambda i: i)).alias("item_ix", "item"))
    return rows.select(
        "shipment_id", F.coalesce("item_ix", F.lit(0)).alias("item_ix"), F.col("item").isNotNull().alias("real"),
        *[filled(F.col(f"item.{n}")).alias(n) for n in ITEM_TEXTS],
        F.coalesce("item.quantity_value", F.lit(0.0)).alias("quantity_value"), F.coalesce("item.unit_price", F.lit(0.0)).alias("unit_price"), F.col("item.batches").alias("batches"),
    )


def item_batches(items: DataFrame) -> DataFrame:
    """One row per batch with its item's name; an item without batches has one row of blanks."""
    kept = F.filter("batches", lambda b: b.isNotNull())
    rows = items.select("shipment_id", "item_ix", "material_name", F.posexplode_outer(kept).alias("batch_ix", "batch"))
    return rows.select("shipment_id", "item_ix", F.coalesce("batch_ix", F.lit(0)).alias("batch_ix"), "material_name", *[filled(F.col(f"batch.{n}")).alias(n) for n in BATCH_TEXTS])


def joined_batches(batches: Column, field: str) -> Column:
    """The values of a batch field that aren't empty, in order, joined by ' / '."""
    return F.array_join(F.filter(F.transform(batches, lambda b: filled(b[field])), lambda x: x != ""), " / ")


def exact_sum(value: Column) -> Column:
    """Aggregate: a sum in millionths, which doesn't depend on the order of adding."""
    return F.sum(value.cast("decimal(30,6)")).cast("double")


def plain_sum(value: Column) -> Column:
    """Aggregate: the sum with absent values as 0; 0 of nothing."""
    return F.coalesce(F.sum(F.coalesce(value, F.lit(0.0))), F.lit(0.0))


def named_once(name: Column, none: str = "N/A") -> Column:
    """Aggregate: the distinct values that aren't empty, sorted by code point and joined; ``none`` if there are none."""
    all_ = F.array_join(F.array_sort(F.collect_set(F.nullif(name, F.lit("")))), ", ")
    return F.when(all_ == "", none).otherwise(all_)


def summed_weights(rows: DataFrame, keys: list[str], text: str, order: str, into: str) -> DataFrame:
    """(keys, ``into``): weights like '12.00 KG' summed per unit.

    Masses are summed in grams and shown in KG from 1,000 g, else G; other units follow by first appearance, then what
    can't be read. What follows number and unit is ignored; empty texts count for nothing. Partial sums per unit are made
    before the one exchange on the keys.
    """
    trimmed = python_trim(filled(text))
    unit = F.regexp_replace(F.regexp_replace(F.upper(F.regexp_extract(trimmed, WEIGHT, 2)), "S+$", ""), r"\.+$", "")
    amount = F.replace(F.regexp_extract(trimmed, WEIGHT, 1), F.lit(","), F.lit("")).try_cast("double")
    grams = F.create_map(*[F.lit(v) for p in GRAMS.items() for v in p])
    factor = F.coalesce(F.try_element_at(grams, unit), F.try_element_at(grams, F.concat(unit, F.lit("S"))))
    parsed = rows.select(*keys, F.col(order).alias("_o"), trimmed.alias("_t"), unit.alias("_u"), amount.alias("_n"), factor.alias("_f")).where("_t <> ''")
    kind = F.when(F.col("_n").isNull(), 2).when(F.col("_f").isNotNull(), 0).otherwise(1)
    parts = parsed.select(*keys, "_o", kind.alias("_k"), F.when(kind == 0, "").when(kind == 1, F.col("_u")).otherwise(F.concat(F.format_string("%012d|", F.col("_o").cast("long")), "_t")).alias("_g"), F.when(kind == 0, F.col("_n") * F.col("_f")).otherwise(F.col("_n")).alias("_v"), "_t")
    sums = parts.groupBy(*keys, "_k", "_g").agg(F.sum("_v").alias("_v"), F.min("_o").alias("_o"), F.min("_t").alias("_t"))
    said = F.when(F.col("_k") == 0, F.when(F.col("_v") >= 1000, F.concat(F.format_number(F.col("_v") / 1000, 2), F.lit(" KG"))).otherwise(F.concat(F.format_number("_v", 2), F.lit(" G"))))
    said = said.when(F.col("_k") == 1, F.concat(F.format_number("_v", 2), F.lit(" "), F.col("_g"))).otherwise(F.col("_t"))
    ordered = F.array_sort(F.collect_list(F.struct("_k", "_o", said.alias("s"))))
    return sums.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), " + ").alias(into))


def shipment_totals(shipments: DataFrame) -> DataFrame:
    """Per shipment: grand total, currency of the first item (USD if none), makers and materials named once."""
    items = shipment_items(shipments)
    first = F.min_by("currency", "item_ix")
    return items.groupBy("shipment_id").agg(
        F.count_if("real").alias("n_items"), exact_sum(item_total(F.col("quantity_value"), F.col("unit_price"))).alias("grand_total"),
        F.when(first == "", "USD").otherwise(first).alias("currency"), named_once(F.col("manufacturer")).alias("manufacturers"), named_once(F.col("material_name")).alias("materials"),
    )
