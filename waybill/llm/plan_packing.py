"""Queries on packing texts into containers (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.packing import CAPACITY, count_tokens, pack
from waybill.session import cut, read_table, spread


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its container."""
    documents = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pack(cut(count_tokens(documents)))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_containers(spark, sf_dir).where("n_pieces > 1").select("doc_id").distinct()


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of containers, tokens in them and the share of space used."""
    boxes = p7_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("tokens").alias("tokens"))
    return boxes.agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"), (F.sum("tokens") / (F.count("*") * F.lit(CAPACITY))).alias("fill"))


QUERIES = {"p7_found": p7_found, "p7_containers": p7_containers, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
