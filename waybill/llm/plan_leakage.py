"""Queries on evaluation passages in documents (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waybill.llm.leakage import find_passages, merge_spans
from waybill.session import cut, read_table, spread


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_passages(spread(documents), read_table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to cut from which document, in characters."""
    return merge_spans(cut(passages(spark, sf_dir)))


QUERIES = {"p8_found": p8_found, "p8_removal_spans": p8_removal_spans}
ORACLE: dict[str, str] = {}
