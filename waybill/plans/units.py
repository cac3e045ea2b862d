"""Queries on quantities in many units (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.operators.units import normalise_quantities
from waybill.session import read_table, spread

WEIGHTS = ("net_weight_text", "gross_weight_text")


def stated_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated quantity with where it stands: source, record_id, item_ix, field, value, unit, text, description."""
    empty = F.lit(None).cast("string")
    po = read_table(spark, sf_dir, "purchase_orders").select(
        F.lit("po").alias("source"), F.col("po_id").cast("long").alias("record_id"), F.lit(-1).alias("item_ix"), F.lit("quantity").alias("field"),
        F.col("quantity").alias("value"), "unit", empty.alias("text"), F.col("description_full").alias("description"), "site_code",
    )
    wanted = ("quantity_value", "unit", "quantity_text", *WEIGHTS)
    none = F.lit(None).cast("double")
    kinds = F.array(
        F.struct(F.lit("quantity").alias("field"), F.col("item.quantity_value").alias("value"), F.col("item.unit").alias("unit"), F.col("item.quantity_text").alias("text")),
        *[F.struct(F.lit(w).alias("field"), none.alias("value"), empty.alias("unit"), F.col(f"item.{w}").alias("text")) for w in WEIGHTS],
    )
    items = (
        read_table(spark, sf_dir, "shipments")
        .select("shipment_id", "site_code", F.posexplode(F.transform("items", lambda i: F.struct(*[i[w].alias(w) for w in wanted]))).alias("item_ix", "item"))
        .select("shipment_id", "site_code", "item_ix", F.explode(kinds).alias("q"))
        .select(F.lit("item").alias("source"), F.col("shipment_id").cast("long").alias("record_id"), "item_ix", "q.*", empty.alias("description"), "site_code")
    )
    return po.unionByName(items).where("value > 0 OR text IS NOT NULL AND text <> ''")


def normal_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = read_table(spark, sf_dir, "sites").select("site_code", "decimal_mark")
    return normalise_quantities(spread(stated_quantities(spark, sf_dir)).join(sites, "site_code", "left"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_quantities(spark, sf_dir).where("amount IS NOT NULL").select("source", "record_id", "item_ix", "field", "dim", "amount").distinct()


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total per source, field and dimension, each record once."""
    rows = normal_quantities(spark, sf_dir).where("amount IS NOT NULL").select("source", "record_id", "item_ix", "field", "dim", "amount").distinct()
    return rows.groupBy("source", "field", "dim").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(38,0)")).alias("total"))


QUERIES = {"p4_found": p4_found, "p4_totals": p4_totals}
ORACLE: dict[str, str] = {}
