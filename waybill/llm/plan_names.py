"""Queries on names of organisations (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.names import link_names, pairs_of_names
from waybill.session import cut, read_table


def written_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of an organisation, as written, each spelling once."""
    customers = read_table(spark, sf_dir, "customers").select("name")
    orders = read_table(spark, sf_dir, "purchase_orders").select(F.split_part("consignee", F.lit("\n"), F.lit(1)).alias("name"))
    makers = read_table(spark, sf_dir, "shipments").select(F.explode(F.transform("items", lambda i: i["manufacturer"])).alias("name"))
    return customers.unionByName(orders).unionByName(makers).where(F.col("name").rlike(r"(?U)\S")).distinct()


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organisation of each spelling, with how many spellings it has."""
    entities = cut(link_names(written_names(spark, sf_dir)))
    return entities.join(entities.groupBy("entity").agg(F.count("*").alias("n_spellings")), "entity").select("name", "entity", "n_spellings")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of_names(cut(link_names(written_names(spark, sf_dir))))


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
ORACLE: dict[str, str] = {}
