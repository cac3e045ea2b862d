"""Queries on postal addresses (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.addresses import pairs_of_places, same_places
from waybill.session import cut, read_table


def address_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, text, trusted): customers and purchase orders, each record once."""
    customers = read_table(spark, sf_dir, "customers").select(F.concat(F.lit("c:"), "id").alias("key"), F.col("full_text").alias("text"), F.lit(True).alias("trusted"))
    orders = read_table(spark, sf_dir, "purchase_orders").select(F.concat(F.lit("p:"), F.col("po_id").cast("string")).alias("key"), F.col("consignee").alias("text"), F.lit(False).alias("trusted"))
    return customers.unionByName(orders).where("key IS NOT NULL AND text IS NOT NULL")


def p6_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place or places of each customer and purchase order."""
    return same_places(address_records(spark, sf_dir), "key", "text", "trusted")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of_places(cut(p6_places(spark, sf_dir)), "key", "c:")


QUERIES = {"p6_found": p6_found, "p6_places": p6_places}
ORACLE: dict[str, str] = {}
