"""Insert, update and delete by key over immutable tables: each returns the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.functions.text import filled, slug
from waybill.session import python_trim


def with_ids(new: DataFrame, existing: DataFrame, name: str = "name", order: str = "name") -> DataFrame:
    """Give new records ids: the slug of the name, suffixed from 2 where it is taken by existing or earlier new ones.

    Suffixes already in use are skipped: the k-th record of a slug gets the k-th free number.
    """
    base = new.withColumn("_base", slug(name))
    taken = existing.select(F.regexp_extract("id", r"^(.*?)(?:-(\d+))?$", 1).alias("_base"), F.col("id")).unionByName(existing.select(F.col("id").alias("_base"), "id")).distinct()
    used = taken.groupBy("_base").agg(F.collect_set("id").alias("_used"))
    numbered = base.withColumn("_k", F.row_number().over(Window.partitionBy("_base").orderBy(order))).join(used, "_base", "left")
    numbers = F.sequence(F.lit(1), F.col("_k") + F.size(F.coalesce("_used", F.array().cast("array<string>"))))
    name_of = lambda n: F.when(n == 1, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit("-"), n.cast("string")))
    free = F.filter(F.transform(numbers, name_of), lambda i: ~F.coalesce(F.array_contains("_used", i), F.lit(False)))
    return numbered.withColumn("id", F.get(free, F.col("_k") - 1)).drop("_base", "_k", "_used")


def insert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Records added; a name is required, a blank text is the name."""
    clean = new.select(python_trim(filled("name")).alias("name"), python_trim(filled("full_text")).alias("full_text"))
    clean = clean.withColumn("name", F.when(F.col("name") == "", F.raise_error(F.lit("a name is required")).cast("string")).otherwise(F.col("name")))
    clean = clean.withColumn("full_text", F.when(F.col("full_text") == "", F.col("name")).otherwise(F.col("full_text")))
    return existing.select("id", "name", "full_text").unionByName(with_ids(clean, existing).select("id", "name", "full_text"))


def update(existing: DataFrame, changes: DataFrame, strict: bool = True) -> DataFrame:
    """Records changed by id; a blank value keeps the old one. ``strict``: an id that isn't there is an error."""
    c = changes.select("id", F.nullif(filled("name"), F.lit("")).alias("_n"), F.nullif(filled("full_text"), F.lit("")).alias("_t"))
    out = existing.join(c, "id", "left" if not strict else "full_outer") if strict else existing.join(c, "id", "left")
    name = F.when(F.col("name").isNull() & F.col("full_text").isNull() & F.lit(strict), F.raise_error(F.concat(F.lit("no record "), F.col("id"))).cast("string")).otherwise(python_trim(F.coalesce("_n", "name")))
    return out.select("id", name.alias("name"), python_trim(F.coalesce("_t", "full_text")).alias("full_text"))


def delete(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select("id"), "id", "left_anti")


def missing(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids to delete or update that aren't there."""
    return ids.select("id").join(existing.select("id"), "id", "left_anti")


def upsert_cells(cells: DataFrame, written: DataFrame, keys: tuple[str, ...] = ("sheet", "ref")) -> DataFrame:
    """Cells overwritten or added by reference; a cell keeps its style, a written value clears its formula."""
    w = written.select(*keys, F.col("value").alias("_v"), F.lit(True).alias("_w"))
    joined = cells.join(w, list(keys), "full_outer")
    return joined.select(*keys, F.when(F.col("_w"), F.col("_v")).otherwise(F.col("value")).alias("value"), F.when(F.col("_w").isNull(), F.col("formula")).alias("formula"), "style")


def search(records: DataFrame, query: str, column: str = "name") -> DataFrame:
    """Records whose name contains the query, case aside; all for a blank one."""
    return records.where(F.contains(F.lower(F.col(column)), F.lit(query.strip().lower())))
