"""Two documents compared field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions.text import filled, normalize
from waybill.session import python_trim


def compare_fields(left: DataFrame, right: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, field, left_value, right_value, status) of two long tables (key, field, value).

    match, mismatch, missing_in_left or missing_in_right; case, punctuation and spacing aside. Fields empty on both sides
    are left out; the first value of a repeated field counts.
    """
    side = lambda d, name: d.groupBy(key, "field").agg(F.min(F.when(python_trim(filled("value")) != "", F.col("value"))).alias(name))
    both = side(left, "left_value").join(side(right, "right_value"), [key, "field"], "full_outer").where("left_value IS NOT NULL OR right_value IS NOT NULL")
    status = F.when(F.col("left_value").isNull(), "missing_in_left").when(F.col("right_value").isNull(), "missing_in_right").when(normalize("left_value") == normalize("right_value"), "match").otherwise("mismatch")
    return both.withColumn("status", status)


def overall(compared: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, overall_status, n_match, n_mismatch, n_missing): a match only if nothing mismatches."""
    n = lambda s: F.count_if(F.col("status").rlike(s))
    counted = compared.groupBy(key).agg(n("^match$").alias("n_match"), n("^mismatch$").alias("n_mismatch"), n("^missing").alias("n_missing"))
    return counted.withColumn("overall_status", F.when(F.col("n_mismatch") > 0, "mismatch").otherwise("match"))


def unpivot(wide: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of the named columns as text."""
    return wide.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], fields, "field", "value")
