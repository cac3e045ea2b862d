"""Queries on the languages of documents (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.language import _LABEL, fit_language_model, label_languages
from waybill.session import read_table, spread


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every document with its language and confidence."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return label_languages(spread(documents), fit_language_model(documents))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = p9_segments(spark, sf_dir)
    code = F.create_map(*[F.lit(x) for pair in _LABEL.items() for x in pair])
    word = F.lower(F.trim(F.col("lang_given")))
    given = F.coalesce(F.try_element_at(code, word), F.try_element_at(code, F.split(word, r"[-_\s(]")[0]))
    doc = Window.partitionBy("doc_id")  # a document's few stretches
    marked = segments.withColumn("_n", F.max("seg_ix").over(doc)).withColumn("_given", given)
    wrong = (F.col("_n") > 0) | F.col("_given").isNull() | (F.col("_given") != F.col("lang"))
    return marked.where(wrong).select("doc_id", "seg_ix", "lang").distinct()


QUERIES = {"p9_found": p9_found, "p9_segments": p9_segments}
ORACLE: dict[str, str] = {}
