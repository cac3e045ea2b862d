"""Queries on printed dates (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.operators.timestamps import normalise_timestamps, zone_tables
from waybill.session import python_trim, read_table, spread

BATCH_DATES = ("manufacturing_date", "expiry_date", "retest_date")


def printed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every printed date with where it stands: source, record_id, item_ix, batch_ix, field, site_code, text."""
    minus = F.lit(-1)
    place = lambda source, key, item, batch, field: [F.lit(source).alias("source"), F.col(key).cast("long").alias("record_id"), item.cast("int").alias("item_ix"), batch.cast("int").alias("batch_ix"), field.alias("field"), "site_code"]
    po = read_table(spark, sf_dir, "purchase_orders").select(*place("po", "po_id", minus, minus, F.lit("po_date")), F.col("po_date").alias("text"))
    # an invoice's date and those of its batches come from one pass over the shipments
    none = F.array().cast("array<struct<item_ix:int,batch_ix:int,field:string,text:string>>")
    date = lambda item, batch, field, text: F.struct(item.cast("int").alias("item_ix"), batch.cast("int").alias("batch_ix"), F.lit(field).alias("field"), text.alias("text"))
    of_batch = lambda b, i, k: F.array(*[date(i, k, f, b[f]) for f in BATCH_DATES])
    of_item = lambda item, i: F.coalesce(F.flatten(F.transform(item["batches"], lambda b, k: of_batch(b, i, k))), none)
    dates = F.concat(F.array(date(minus, minus, "invoice_date", F.col("invoice_date"))), F.coalesce(F.flatten(F.transform("items", of_item)), none))
    shipments = read_table(spark, sf_dir, "shipments").select("shipment_id", "site_code", F.explode(dates).alias("date"))
    source = F.when(F.col("date.field") == "invoice_date", "shipment").otherwise("batch")
    printed = shipments.select(source.alias("source"), F.col("shipment_id").cast("long").alias("record_id"), "date.item_ix", "date.batch_ix", "date.field", "site_code", "date.text")
    return po.unionByName(printed).where("text IS NOT NULL AND text <> ''")


def normal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = read_table(spark, sf_dir, "sites").select("site_code", F.col("zone_name").alias("_zone"), F.col("numeric_order").alias("_order"))
    # sites is a fixed table of a few rows; the planner broadcasts it by its size
    return normalise_timestamps(spread(printed_dates(spark, sf_dir)).join(sites, "site_code", "left"), "text", "_zone", "_order", "norm")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normal_dates(spark, sf_dir).where(F.col("norm").isNotNull() & (python_trim("text") != F.col("norm")))
    return found.select("source", "record_id", "item_ix", "batch_ix", "field", "norm").distinct()


def p2_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct printed dates have which precision, by field; unreadable ones included."""
    precision = F.when(F.col("norm").isNull(), "none").when(F.length("norm") == 7, "month").when(F.length("norm") == 10, "day").otherwise("second")
    dates = normal_dates(spark, sf_dir).select("source", "record_id", "item_ix", "batch_ix", "field", precision.alias("precision")).distinct()
    return dates.groupBy("field", "precision").agg(F.count("*").alias("n"))


def p2_zone_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone transition tables that the sites' local times go through, with the version of the database."""
    zones = [r["zone_name"] for r in read_table(spark, sf_dir, "sites").select("zone_name").where("zone_name IS NOT NULL").distinct().collect()]  # a fixed table of a few rows
    return zone_tables(spark, zones)


QUERIES = {"p2_found": p2_found, "p2_precision": p2_precision, "p2_zone_tables": p2_zone_tables}
ORACLE: dict[str, str] = {}
