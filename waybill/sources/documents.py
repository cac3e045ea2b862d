"""Documents of any kind, customer files and extraction behind interfaces."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.text import data_url, filled, line_fields, text_lines
from waybill.sources.office import binary_files, docx_text, read_docx

CUSTOMER_SCHEMA = "id string, name string, full_text string"
ANSWER_SCHEMA = "header_fields array<struct<label string, value string>>, test_results array<struct<parameter string, specification string, result string>>, signature struct<present boolean, page_number int, description string, bbox array<double>>"
# Kinds of document by extension.
KINDS = {"pdf": "pdf", "docx": "docx"} | dict.fromkeys(("png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff"), "image")


def kind_of(filename) -> F.Column:
    """pdf, image or docx by the file name's extension; null for any other."""
    return F.try_element_at(F.create_map(*[F.lit(v) for p in KINDS.items() for v in p]), F.regexp_extract(F.lower(filename), r"\.([^./\\]+)$", 1))


def read_documents(spark: SparkSession, folder: str, pdf_text=None) -> DataFrame:
    """(filename, kind, text, image_url, text_reliable) of the files of a folder; other kinds go to :func:`unsupported`.

    ``pdf_text`` is a plug-in: a function of (path, content) rows that gives (path, text). Without one, PDFs have no text.
    """
    files = binary_files(spark, folder, "*").withColumn("kind", kind_of(F.col("path")))
    words = docx_text(read_docx(files.where("kind = 'docx'")))
    if pdf_text is not None:
        words = words.unionByName(pdf_text(files.where("kind = 'pdf'").select("path", "content")))
    known = files.where("kind IS NOT NULL").join(words, "path", "left")
    return known.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "kind", filled("text").alias("text"), F.when(F.col("kind") == "image", data_url("content", "path")).alias("image_url"), (filled("text") != "").alias("text_reliable"))


def unsupported(spark: SparkSession, folder: str) -> DataFrame:
    return binary_files(spark, folder, "*").where(kind_of(F.col("path")).isNull()).select("path")


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CUSTOMER_SCHEMA).json(path, multiLine=True)


def write_customers(customers: DataFrame, path: str) -> None:
    """The whole table to a new place; swap folders afterwards, never write over what is read."""
    customers.select("id", "name", "full_text").write.json(path)


def templates(spark: SparkSession, folder: str, pinned: str = "") -> DataFrame:
    """(name, path, pinned) of the templates of a folder, a pinned virtual one first."""
    found = binary_files(spark, folder, "*.docx").select(F.regexp_extract("path", r"([^/]+)\.docx$", 1).alias("name"), "path", F.lit(False).alias("pinned"))
    first = spark.createDataFrame([(pinned, "", True)], "name string, path string, pinned boolean").where("name <> ''")
    return first.unionByName(found).orderBy(F.desc("pinned"), "path")


class Extractor(Protocol):
    """Turns documents (filename, text, text_reliable) into (filename, raw): an answer as JSON text each."""

    def __call__(self, documents: DataFrame) -> DataFrame: ...


def rule_extractor(documents: DataFrame) -> DataFrame:
    """An extractor without a model: 'label: value' pairs of the text's lines become header fields."""
    pairs = F.flatten(F.transform(text_lines("text"), line_fields))
    answer = F.struct(pairs.alias("header_fields"), F.array().cast("array<struct<parameter string, specification string, result string>>").alias("test_results"))
    return documents.select("filename", F.to_json(answer).alias("raw"))


def prompt(text="text", reliable="text_reliable") -> F.Column:
    """What an extractor that reads prompts is told about a text."""
    warn = F.concat(F.lit("The text layer is unreliable; read the images.\n"), F.col(text))
    return F.when(filled(text) == "", "No text layer; read the images.").when(~F.coalesce(F.col(reliable), F.lit(False)), warn).otherwise(F.col(text))


def typed_answers(raw: DataFrame, key: str, column: str = "raw") -> DataFrame:
    """(key, answer, corrupt): answers that follow the schema to the letter; ``corrupt`` keeps those that don't."""
    parsed = F.from_json(F.col(column), ANSWER_SCHEMA)
    return raw.select(F.col(key), parsed.alias("answer"), F.when(parsed.isNull() | F.coalesce(parsed["header_fields"], F.lit(None)).isNull() & F.coalesce(parsed["test_results"], F.lit(None)).isNull(), F.col(column)).alias("corrupt"))


def pages_of_pdf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The interface of a PDF plug-in: (path, page_number, width, height, text, png); none is built in."""
    raise NotImplementedError("no PDF reader is installed; pass a function to read_documents")
    yield from batches


def response(columns: list[str]) -> F.Column:
    """A report as JSON text, absent values as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def download_name_ok(name) -> F.Column:
    return ~name.rlike(r"[/\\]") & name.rlike(r"\.(docx|xlsx)$")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Iterator", "Protocol", "pd")]
