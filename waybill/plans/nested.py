"""Queries on nested records (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.operators.dewey import child_table, flatten_json, flatten_typed, tables
from waybill.plans.tables import ANSWER_TREE, RESULT_FIELDS, SHIPMENT_TREE
from waybill.session import read_table, spread


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipments = flatten_typed(read_table(spark, sf_dir, "shipments").select("shipment_id", "items"), "shipment_id", SHIPMENT_TREE, payload=False)
    answers = flatten_json(spread(read_table(spark, sf_dir, "coa_records").select("coa_id", "raw")), "coa_id", "raw", ANSWER_TREE, payload=False)
    shape = lambda source, key, rows: rows.select(F.lit(source).alias("source"), F.col(key).cast("long").alias("record_id"), "node_path", "parent_path")
    return shape("shipment", "shipment_id", shipments).unionByName(shape("raw", "coa_id", answers)).distinct()


def p5_shipment_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct parents of each table the shipments fall into; each shipment once."""
    shipments = read_table(spark, sf_dir, "shipments").select("shipment_id", "items").dropDuplicates(["shipment_id"])
    nodes = flatten_typed(shipments, "shipment_id", SHIPMENT_TREE, payload=False)
    return nodes.groupBy("schema_path").agg(F.count("*").alias("n_rows"), F.countDistinct("shipment_id", "parent_path").alias("n_parents"))


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of shipment items; each shipment once."""
    return child_table(read_table(spark, sf_dir, "shipments").select("shipment_id", "items").dropDuplicates(["shipment_id"]), "shipment_id", "items")


def p5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of batches, which point to their items; each shipment once."""
    return child_table(read_table(spark, sf_dir, "shipments").select("shipment_id", "items").dropDuplicates(["shipment_id"]), "shipment_id", "items.batches")


def p5_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of test results in the raw answers; each certificate once."""
    coa = read_table(spark, sf_dir, "coa_records").select("coa_id", "raw").dropDuplicates(["coa_id"])
    return tables(flatten_json(spread(coa), "coa_id", "raw", ANSWER_TREE), "coa_id", {"test_results": RESULT_FIELDS})["test_results"]


QUERIES = {"p5_found": p5_found, "p5_shipment_tables": p5_shipment_tables, "p5_items": p5_items, "p5_batches": p5_batches, "p5_results": p5_results}

_OWN_ITEM = "material_name manufacturer quantity_text quantity_value unit unit_price currency packaging_description package_count_text gross_weight_text net_weight_text".split()
_OWN_BATCH = "batch_no manufacturing_date expiry_date retest_date".split()

ORACLE = {
    "p5_shipment_tables": """
        WITH s AS (SELECT shipment_id, any_value(items) AS items FROM shipments GROUP BY shipment_id),
        i AS (SELECT shipment_id, ix, items[ix] AS item FROM s, unnest(generate_series(1, len(items))) t(ix)),
        b AS (SELECT shipment_id, ix, bx, item.batches[bx] AS batch FROM i, unnest(generate_series(1, len(item.batches))) t(bx) WHERE item IS NOT NULL)
        SELECT 'items' AS schema_path, count(*) AS n_rows, count(DISTINCT shipment_id) AS n_parents FROM i WHERE item IS NOT NULL
        UNION ALL
        SELECT 'items.batches', count(*), count(DISTINCT (shipment_id, ix)) FROM b WHERE batch IS NOT NULL
    """,
    "p5_items": f"""
        WITH s AS (SELECT shipment_id, any_value(items) AS items FROM shipments GROUP BY shipment_id)
        SELECT shipment_id, 'items[' || (ix - 1) || ']' AS node_path, '' AS parent_path, {", ".join(f"items[ix].{c} AS {c}" for c in _OWN_ITEM)}
        FROM s, unnest(generate_series(1, len(items))) t(ix) WHERE items[ix] IS NOT NULL
    """,
    "p5_batches": f"""
        WITH s AS (SELECT shipment_id, any_value(items) AS items FROM shipments GROUP BY shipment_id),
        i AS (SELECT shipment_id, 'items[' || (ix - 1) || ']' AS parent, items[ix].batches AS batches FROM s, unnest(generate_series(1, len(items))) t(ix) WHERE items[ix] IS NOT NULL)
        SELECT shipment_id, parent || '.batches[' || (bx - 1) || ']' AS node_path, parent AS parent_path, {", ".join(f"batches[bx].{c} AS {c}" for c in _OWN_BATCH)}
        FROM i, unnest(generate_series(1, len(batches))) t(bx) WHERE batches[bx] IS NOT NULL
    """,
}
