from pyspark.sql import functions as F

from waybill.operators import pictures as P


def test_caps_and_boxes(spark):
    rows = [(1, 1, i, 30, 30 if i else 10, 10.0, 20.0, 60.0, 80.0, 100.0, 100.0) for i in range(50)]
    kept = P.kept_pictures(spark.createDataFrame(rows, "doc_id long, page int, picture_ix int, width int, height int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"))
    got = kept.orderBy("picture_ix").collect()
    assert [r["picture_ix"] for r in got] == list(range(1, 41))
    assert [round(v, 6) for v in got[0]["box"]] == [0.1, 0.2, 0.6, 0.8]


def test_shared_numbers_titles(spark):
    d = spark.createDataFrame([(1, "r1", "a", 0, 0), (1, "r1", "b", 9, 0), (1, "r2", "a", 3, 1)], "doc_id long, rel_id string, drawing_id string, row_ix int, cell_ix int")
    assert [r["shared"] for r in P.shared_pictures(d).orderBy("rel_id", "row_ix").collect()] == [True, True, False]
    rows = spark.createDataFrame([(1, i, n, t) for i, (n, t) in enumerate([("1.", None), ("x", "A b"), (None, "A b"), ("7)", None)])], "doc_id long, row_ix int, no string, title string")
    assert {(r["drawing_id"], r["row_ix"]) for r in P.reattached(d, rows).collect()} == {("a", 0), ("b", 3)}
    assert P.next_number(rows).first()["next"] == 8
    assert [(r["merge"], r["shown"]) for r in P.merged_titles(rows).orderBy("row_ix").collect()] == [(None, None), ("restart", "A b"), ("continue", ""), (None, None)]
    assert spark.range(1).select(P.keeps_own_stamp(F.lit("My  Form"), ["my form"]).alias("x")).first()["x"]
