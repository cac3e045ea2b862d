"""Pictures, pages and numbered rows of templates: caps, shared pictures, re-attachment, titles of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages rendered for extraction, pages converted with their layout, pictures kept of a document.
PAGES, LAYOUT_PAGES, PICTURES = 5, 15, 40
LEAST_SIDE = 25


def first_of(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group in order: a cap of the product (pages, pictures), not of the engine."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def kept_pictures(pictures: DataFrame) -> DataFrame:
    """Pictures of 25 pixels a side at least, the first 40 of a document, with their box as fractions from the top left."""
    big = first_of(pictures.where((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE)), ["doc_id"], ["page", "picture_ix"], PICTURES)
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    if "x0" not in pictures.columns:
        return big
    return big.withColumn("box", F.struct(unit(F.col("x0") / F.col("page_width")).alias("x0"), unit(1 - F.col("y1") / F.col("page_height")).alias("y0"), unit(F.col("x1") / F.col("page_width")).alias("x1"), unit(1 - F.col("y0") / F.col("page_height")).alias("y1")))


def aspect(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(0.0)


def shared_pictures(drawings: DataFrame) -> DataFrame:
    """Drawings with ``shared``: whether their picture is used elsewhere in the document, so must be copied before it is changed."""
    return drawings.withColumn("shared", F.count("*").over(Window.partitionBy("doc_id", "rel_id")) > 1)


def reattached(drawings: DataFrame, rows: DataFrame) -> DataFrame:
    """Drawings of a results table after its rows changed: one copy each, moved to the nearest row that is left."""
    once = first_of(drawings, ["doc_id", "drawing_id"], ["row_ix", "cell_ix"], 1)
    last = rows.groupBy("doc_id").agg(F.max("row_ix").alias("_last"))
    return once.join(last, "doc_id").withColumn("row_ix", F.least("row_ix", "_last")).drop("_last")


def next_number(rows: DataFrame, number: str = "no") -> DataFrame:
    """(doc_id, next): one more than the largest row number a document's table shows; 1 if it shows none."""
    shown = F.regexp_extract(F.coalesce(F.col(number).cast("string"), F.lit("")), r"(\d+)", 1).try_cast("int")
    return rows.groupBy("doc_id").agg((F.coalesce(F.max(shown), F.lit(0)) + 1).alias("next"))


def merged_titles(rows: DataFrame, title: str = "title") -> DataFrame:
    """Rows of a titled run with ``merge``: restart with the title in the first, continue without in the rest, null outside runs."""
    doc = Window.partitionBy("doc_id").orderBy("row_ix")
    first = F.col(title).isNotNull() & ~F.coalesce(F.col(title) == F.lag(title).over(doc), F.lit(False))
    merge = F.when(F.col(title).isNull(), None).when(first, "restart").otherwise("continue")
    return rows.withColumn("merge", merge).withColumn("shown", F.when(merge == "restart", F.col(title)).when(merge == "continue", ""))


def keeps_own_stamp(name: Column, exempt: list[str]) -> Column:
    """Whether a template's name, spaces and case aside, is in a set of those that keep their stamp."""
    return F.regexp_replace(F.lower(name), r"\s+", "").isin([e.lower().replace(" ", "") for e in exempt])


def cleared_background(rgba: Column) -> Column:
    """Alpha of a pixel: 0 where red, green and blue are all 235 or more."""
    return F.when((rgba["r"] >= 235) & (rgba["g"] >= 235) & (rgba["b"] >= 235), 0).otherwise(rgba["a"])
