import random

from hypothesis import given, settings
from hypothesis import strategies as st

from waybill.llm.packing import best_fit, count_tokens, pack


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_keeps_items_whole_and_within(sizes):
    boxes = best_fit([(s, [(i, s)]) for i, s in enumerate(sizes)], 50)
    assert sorted(i for _, c in boxes for i, _ in c) == list(range(len(sizes)))
    assert all(size == sum(s for _, s in c) <= 50 for size, c in boxes)
    assert sum(2 * size <= 50 for size, _ in boxes) <= 1  # any-fit: at most one container is half empty


def test_pack_whole_items_split_giants(spark):
    random.seed(4)
    rows = [(i, random.choice([random.randint(1, 300), random.randint(1, 2048), random.randint(2049, 9000)])) for i in range(3000)] + [(5000, 2048), (5001, 4096), (5002, 0), (5003, None), (5004, 1), (5004, 1)]
    got = pack(spark.createDataFrame([(i, n, "x") for i, n in rows], "doc_id long, n_tokens int, tokens string").repartition(20)).collect()
    want = {}
    for i, n in rows:
        want[i] = want.get(i, 0) + (n or 0)
    total, boxes, pieces = {}, {}, {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["tokens"]
        boxes[r["container_id"]] = boxes.get(r["container_id"], 0) + r["tokens"]
        pieces.setdefault(r["doc_id"], set()).add(r["n_pieces"])
    assert total == {i: n for i, n in want.items() if n}
    assert max(boxes.values()) <= 2048
    assert all(pieces[i] == {-(-n // 2048)} for i, n in rows if n and i != 5004)
    assert sum(total.values()) / (len(boxes) * 2048) > 0.97


def test_items_that_never_go_together(spark):
    got = pack(spark.createDataFrame([(i, 1500) for i in range(500)], "doc_id long, n_tokens int").repartition(8))
    assert got.select("container_id").distinct().count() == 500
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens int")).count() == 0


def test_tokens_of_edges(spark):
    df = spark.createDataFrame([(1, "Hello world", "a"), (2, None, "b"), (3, "", None), (1, "Hello world", "a"), (4, "a b " * 30_000, "")], "doc_id long, text string, n_tokens string")
    got = sorted((r["doc_id"], r["n_tokens"]) for r in count_tokens(df).collect())
    assert got[:2] == [(1, 2), (1, 2)] and got[2][0] == 4 and got[2][1] >= 60_000
