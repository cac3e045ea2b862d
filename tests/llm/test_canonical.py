import random

import pytest

from waybill.llm.canonical import DeleteIndex, deletions, map_by_join, map_to_canonical, spellings_of, spellings_table, weighted_distance
from waybill.llm.lexicon import aliases

TERMS = [(1, "test", "Assay"), (2, "test", "Loss on Drying"), (3, "test", "Residue on Ignition"), (4, "test", "Identification by IR"), (5, "test", "Identification by HPLC"), (6, "label", "Expiry Date"), (7, "country", "Germany"), (8, "country", "Spain")]


@pytest.fixture(scope="module")
def spellings(spark):
    return spellings_of(spark.createDataFrame(TERMS, "term_id int, kind string, term string"), aliases())


@pytest.mark.parametrize(
    ("kind", "value", "entry"),
    [
        ("test", "2.1 ASSAY [in-house]", 1), ("test", "L.O.D.", 2), ("test", "Loss-on-Dryign (max.)", 2), ("test", "Resi. on Igni.", 3), ("test", "lo5s on drying", 2), ("test", "ID (IR) by titration", 4), ("test", "HPLC idenification", 5),
        ("test", "Odour panel score", 0), ("test", "Drying, Loss on", 2), ("label", "Date, Expiry:", 6), ("label", "Fax", 0), ("country", "Made in Deutschland.", 7), ("country", "EU", 0), ("country", "(ESP)", 8), ("country", "Gerrnany origin", 7), ("none", "Assay", 0),
    ],
)
def test_values(spellings, kind, value, entry):
    found = DeleteIndex(spellings).lookup(kind, value)
    assert (found[0] if found else 0) == entry


def test_dictionary_finds_what_a_scan_finds(spellings):
    """Within the weighted bound, the symmetric-delete lookup finds the nearest spelling that a full scan finds."""
    index = DeleteIndex(spellings)
    random.seed(1)
    keys = [k for (kind, k) in index.exact if kind == "test" and len(k) >= 6]
    for _ in range(300):
        key = random.choice(keys)
        at = random.randrange(len(key))
        typo = random.choice([key[:at] + key[at + 1 :], key[:at] + random.choice("abcdefgh") + key[at:], key[:at] + random.choice("xyz") + key[at + 1 :]])
        scan = min(weighted_distance(typo, k) for (kind, k) in index.exact if kind == "test")
        found = index.lookup("test", typo)
        assert found is not None and found[1] <= max(scan, 0.0) + 1e-9


def test_deletions():
    assert deletions("abc", 1) == {"abc", "ab", "ac", "bc"}


def test_operator_edges_and_the_way_beyond_the_bound(spark, spellings):
    rows = [("test", "LOD", "x"), ("test", "LOD", "x"), ("test", None, None), (None, "LOD", ""), ("test", " ", ""), ("test", "z" * 100_000, ""), ("test", "Assya", ""), ("test", "Label colour check", ""), ("country", "Spanien", "")]
    df = spark.createDataFrame(rows, "kind string, value string, term_id string")
    near = [(r["kind"], r["term_id"]) for r in map_to_canonical(df, spellings).collect()]
    assert near == [("test", 2), ("test", 2), ("test", None), (None, 0), ("test", None), ("test", 0), ("test", 1), ("test", 0), ("country", 8)]
    far = map_to_canonical(df, spellings, limit=0)
    assert sorted((str(r["value"])[:9], r["term_id"]) for r in far.collect() if r["term_id"] is not None) == sorted((str(r["value"])[:9], t) for r, (_, t) in zip(df.collect(), near, strict=True) if t is not None)
    assert map_to_canonical(df.limit(0), spellings).count() == 0
    assert {r["term_id"] for r in map_to_canonical(df.where("value = 'LOD'"), []).collect()} == {0}
    assert map_by_join(df.limit(0), spellings).count() == 0


def test_ties_go_to_the_more_frequent_entry():
    index = DeleteIndex([("t", 1, "abcdefx"), ("t", 2, "abcdefy")], {2: 5})
    assert index.lookup("t", "abcdefz")[0] == 2
    assert DeleteIndex([("t", 1, "abcdefx"), ("t", 2, "abcdefy")]).lookup("t", "abcdefz")[0] == 1


def test_values_of_any_length_and_both_ways_alike(spark, spellings):
    long = "Assay (" + "by HPLC method, " * 40 + ")"
    values = [("test", long), ("test", " " * 500 + "LOD" + " " * 500), ("test", "1. " * 300 + "Assay" + " [x]" * 300), ("label", "x" * 3000), ("test", "1. Iron test")]
    df = spark.createDataFrame(values, "kind string, value string")
    near = [r["term_id"] for r in map_to_canonical(df, spellings).collect()]
    assert near[:4] == [1, 2, 1, 0]
    far = {r["value"]: r["term_id"] for r in map_to_canonical(df, spellings, limit=0).collect()}
    assert [far[v] for _, v in values] == near


def test_whole_value_goes_before_its_parts_on_both_ways(spark):
    terms = spark.createDataFrame([(1, "test", "Iron"), (2, "test", "Iron test"), (3, "test", "Copper")], "term_id int, kind string, term string")
    table = spellings_table(terms)
    df = spark.createDataFrame([("test", "Iron test"), ("test", "Iron test."), ("test", "iron"), ("test", "Coper")], "kind string, value string")
    often = spark.createDataFrame([(1, 100)], "term_id int, n long")
    for limit in (1 << 20, 0):
        found = {r["value"]: (r["term_id"], r["term_cost"]) for r in map_to_canonical(df, table, frequency=often, limit=limit).collect()}
        assert {v: t for v, (t, _) in found.items()} == {"Iron test": 2, "Iron test.": 2, "iron": 1, "Coper": 3}
        assert found["Iron test"][1] == 0.0
