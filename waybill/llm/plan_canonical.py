"""Queries on freely typed values (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.canonical import map_to_canonical, spellings_table
from waybill.llm.lexicon import aliases
from waybill.session import read_table, spread


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value with where it stands: source, record_id, pos, kind, value."""
    coa = read_table(spark, sf_dir, "coa_records")
    lists = F.flatten(
        F.array(
            F.transform(F.coalesce("test_results", F.array()), lambda x, i: F.struct(F.lit("test").alias("source"), i.cast("int").alias("pos"), x["parameter"].alias("value"))),
            F.transform(F.coalesce("header_fields", F.array()), lambda x, i: F.struct(F.lit("label").alias("source"), i.cast("int").alias("pos"), x["label"].alias("value"))),
        )
    )
    values = coa.select(F.col("coa_id").cast("long").alias("record_id"), F.explode(lists).alias("x")).select("x.source", "record_id", "x.pos", F.col("x.source").alias("kind"), "x.value")
    origins = read_table(spark, sf_dir, "shipments").select(F.lit("origin").alias("source"), F.col("shipment_id").cast("long").alias("record_id"), F.lit(0).alias("pos"), F.lit("country").alias("kind"), F.col("origin").alias("value"))
    return values.unionByName(origins).where(F.col("value").rlike(r"(?U)\S"))


def mapped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed values that aren't, character for character, entries of their kind, with the entry meant."""
    terms = read_table(spark, sf_dir, "canonical_terms")
    values = typed_values(spark, sf_dir)
    # how often each entry occurs in the data as it stands: at most one row an entry
    entries = terms.select("kind", F.col("term").alias("value"), "term_id").dropDuplicates(["kind", "value"])
    frequency = values.groupBy("kind", "value").count().join(entries, ["kind", "value"]).select("term_id", F.col("count").alias("n"))
    free = spread(values.join(entries.select("kind", "value"), ["kind", "value"], "left_anti"))
    return map_to_canonical(free, spellings_table(terms, aliases()), "kind", "value", frequency)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_values(spark, sf_dir).select("source", "record_id", "pos", "term_id").distinct()


def p1_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that denote no entry, with how many records hold them."""
    return mapped_values(spark, sf_dir).where("term_id = 0").groupBy("kind", "value").agg(F.countDistinct("source", "record_id", "pos").alias("n"))


QUERIES = {"p1_found": p1_found, "p1_misses": p1_misses}
ORACLE: dict[str, str] = {}
