from waybill.llm import queries

COLUMNS = {
    "p1_found": {"source": "string", "record_id": "bigint", "pos": "int", "term_id": "int"},
    "p3_found": {"name_a": "string", "name_b": "string"},
    "p6_found": {"key_a": "string", "key_b": "string"},
    "p7_found": {"doc_id": "bigint"},
    "p8_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p9_found": {"doc_id": "bigint", "seg_ix": "int", "lang": "string"},
}


def test_queries_have_the_columns_asked_for_and_distinct_rows(spark, sf):
    for name, query in queries.QUERIES.items():
        df = query(spark, sf)
        rows = df.collect()
        if name in COLUMNS:
            assert dict(df.dtypes) == COLUMNS[name], name
            assert len(rows) == len({tuple(r) for r in rows}) > 0, name
