import json

from waybill.operators.dewey import child_table, flatten_json, flatten_typed, parent_of, tables

TREE = {"items": {"batches": {}}}
ANSWER = {"header_fields": {}, "test_results": {"sub_items": {"runs": {}}}}


def paths(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, raw string")
    return {(r["k"], r["node_path"], r["parent_path"]) for r in flatten_json(df, "k", "raw", ANSWER).collect()}


def test_parent_is_the_truncated_label():
    assert parent_of("a[0]") == ""
    assert parent_of("a[0].b[12]") == "a[0]"
    assert parent_of("a[0].b[12].c[3]") == "a[0].b[12]"


def test_wrappers_encodings_and_lone_objects(spark):
    inner = {"header_fields": [None, {"label": "x"}], "test_results": {"1": {"parameter": "a", "sub_items": '[{"name": "n", "runs": {"run_no": 1}}]'}, "2": {}}, "usage": {"pages": [{"no": 1}]}}
    text = json.dumps(inner)
    expected = {("header_fields[1]", ""), ("test_results[0]", ""), ("test_results[0].sub_items[0]", "test_results[0]"), ("test_results[0].sub_items[0].runs[0]", "test_results[0].sub_items[0]"), ("test_results[1]", "")}
    shapes = [text, json.dumps({"data": inner}), json.dumps([inner]), json.dumps(text), f"```json\n{text}\n```", "﻿" + text, json.dumps({"result": {"record": inner}, "status": "ok"})]
    found = paths(spark, shapes)
    for i in range(len(shapes)):
        assert {(p, q) for k, p, q in found if k == i} == expected


def test_each_list_is_looked_for_on_its_own_and_encodings_have_no_cap(spark):
    apart = json.dumps({"header_fields": [{"label": "x"}], "data": {"deep": [{"test_results": [{"parameter": "a"}], "header_fields": [{}]}]}})
    assert paths(spark, [apart]) == {(0, "header_fields[0]", ""), (0, "test_results[0]", "")}
    often = json.dumps({"header_fields": [{}]})
    for _ in range(12):
        often = json.dumps(often)
    nested = {"test_results": {}}
    for _ in range(100):
        nested = {"data": nested}
    assert paths(spark, [often, json.dumps(nested)]) == {(0, "header_fields[0]", ""), (1, "test_results[0]", "")}


def test_unreadable_answers_give_nothing(spark):
    assert not paths(spark, [None, "", " ", "Error: timeout", '{"header_fields": [{"label": "x"}', "null", "[]", "{}", "7", '"text"'])


def test_very_long_and_deep(spark):
    many = json.dumps({"header_fields": [{"label": "x" * 50}] * 5000})
    assert len(paths(spark, [many])) == 5000
    assert not paths(spark, ["[" * 5000 + "]" * 5000])


def test_typed_nodes_nulls_ties_and_clashing_names(spark):
    schema = "shipment_id long, node_path string, items array<struct<name: string, batches: array<struct<no: string>>>>"
    rows = [(1, "x", [None, ("a", [("b1",), None, (None,)])]), (1, "x", [None, ("a", [("b1",), None, (None,)])]), (2, None, None), (None, "y", [("c", None)]), (3, "z", [])]
    nodes = flatten_typed(spark.createDataFrame(rows, schema), "shipment_id", TREE)
    got = sorted((r["shipment_id"] or 0, r["node_path"], r["parent_path"]) for r in nodes.collect())
    one = [(1, "items[1]", ""), (1, "items[1].batches[0]", "items[1]"), (1, "items[1].batches[2]", "items[1]")]
    assert got == sorted([*one, *one, (0, "items[0]", "")])
    typed = tables(nodes, "shipment_id", {"items": "name string", "items.batches": "no string"})
    assert {k: t.count() for k, t in typed.items()} == {"items": 3, "items.batches": 4}
    assert {r["name"] for r in typed["items"].collect()} == {"a", "c"}
    child = child_table(spark.createDataFrame(rows, schema), "shipment_id", "items.batches")
    assert child.columns == ["shipment_id", "node_path", "parent_path", "no"]
    assert sorted((r["node_path"], r["no"] or "") for r in child.collect()) == sorted([("items[1].batches[0]", "b1"), ("items[1].batches[2]", "")] * 2)


def test_child_tables_keep_fields_named_like_their_keys(spark):
    df = spark.createDataFrame([(1, [("p", 2)])], "k long, items array<struct<node_path: string, k: int>>")
    assert child_table(df, "k", "items").collect() == [(1, "items[0]", "", "p", 2)]
    assert child_table(df, "k", "items").columns == ["k", "node_path", "parent_path", "field_node_path", "field_k"]


def test_empty_tables(spark):
    schema = "shipment_id long, items array<struct<name: string, batches: array<struct<no: string>>>>"
    assert flatten_typed(spark.createDataFrame([], schema), "shipment_id", TREE).count() == 0
    assert flatten_json(spark.createDataFrame([], "k long, raw string"), "k", "raw", ANSWER).count() == 0
