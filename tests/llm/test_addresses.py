from collections import defaultdict

from waybill.llm.addresses import pairs_of_places, place_tokens, same_places

ROWS = [
    ("c:1", "A\nStreet Porugo - 136\nFree Zone\nPostbox No. 134624\nMilomora - 48532\nCanada", True),
    ("c:2", "B Ltd\nno:136, porgo str. / milomora", True),
    ("p:1", "C\nP.O.B.: 134624; 48532 Milomora; CAN", False),
    ("p:2", "D\n#136 PORUGO ST | 2nd Floor | MILOMRA-48532", False),
    ("c:3", "E\nPorugo Street 137, Milomora", True),
    ("c:4", "F\nPorugo Street 136, Lokupur", True),
    ("c:5", "G", True),
    ("c:6", None, True),
    ("c:7", "", True),
    ("p:3", "H\nGreat Lane 9\nPO BOX 77777\nLokupur", False),
    ("c:8", "I\nGreat Lane 9, Lokupur", True),
    ("c:9", "J\nPO BOX 77777, Lokupur, Singapore", True),
    ("c:10", "K\n" + "near the tower, " * 5000 + "Porugo Street 136, Milomora", True),
]
SCHEMA = "key string, text string, trusted boolean"


def test_tokens(spark):
    r = place_tokens(spark.createDataFrame(ROWS[:1], SCHEMA), "key", "text").first()
    assert (r["numbers"], r["box"], r["post"], r["words"]) == (["136"], "134624", "48532", ["milomora", "porugo"])
    texts = ["A\nBuilding 7, 12 King Road", "A\nBahnhofstrasse 12, 8001 Zürich", "A\n0012 Main Street", "A\nулица Ленина, дом 5, Москва", "A", None]
    rows = place_tokens(spark.createDataFrame(list(enumerate(texts)), "key int, text string"), "key", "text").orderBy("key").collect()
    assert [(r["numbers"], r["post"]) for r in rows] == [(["12", "7"], None), (["12"], "8001"), (["12"], None), (["5"], None), ([], None), ([], None)]
    assert rows[1]["words"] == ["bahnhof", "zurich"] and rows[3]["words"] == ["ленина", "москва"]


def test_places_and_edges(spark):
    df = spark.createDataFrame([(*r, "x") for r in [*ROWS, ROWS[0], ROWS[0]]], SCHEMA + ", place string")
    places = same_places(df, "key", "text", "trusted")
    pairs = {(r["key_a"], r["key_b"]) for r in pairs_of_places(places, "key", "c:").collect()}
    home = {"c:1", "c:10", "c:2", "p:1", "p:2"}
    want = {(a, b) for a in home for b in home if a < b and "c:" in a}
    # the order's street and box are each somebody's, but no customer joins them
    want |= {("c:8", "p:3"), ("c:9", "p:3")}
    assert pairs == want
    assert same_places(df.limit(0), "key", "text", "trusted").count() == 0


def test_numbers_boxes_postcodes_and_other_scripts(spark):
    groups = [
        ["Building 7, 12 Kingsway Road, Milomora", "12 Kingsway Road, Building 7\nMilomora"], ["Building 8, 12 Kingsway Road, Milomora"], ["12 Kingsway Road, Milomora"],
        ["Building 3, 40 Porugo Lane, Lokupur", "40 Porugo Lane, Lokupur"],
        ["12 Gartenstrasse\n10115 Berlin", "12 Gartenstr.\nBerlin 10115"], ["Bahnhofstrasse 12\n8001 Zurich", "Bahnhofstr. 12, Zürich"],
        ["PO Box 123, Ammanov"], ["PO Box 123, Cairona"], ["P.O.Box 123"], ["PO Box 777, Fidabad", "P.O.Box 777"],
        ["улица Ленинова, дом 5, Москвана", "Москвана, Ленинова ул., 5"],
        ["9 Vivaldi Street, Tormelin", "9 Vibaldi St, Tormelin", "9, Vivladi Street, Tromelin"],
    ]
    rows = [(f"c:{i}.{k}", f"X\n{t}", True) for i, g in enumerate(groups) for k, t in enumerate(g)]
    rows += [(f"f:{i}", f"X\n{i + 200} Filler{chr(97 + i % 26)}{chr(97 + i // 26)}oma Street, City{chr(97 + i % 26)}{chr(98 + i // 26)}udi", True) for i in range(100)]
    found = defaultdict(set)
    for r in same_places(spark.createDataFrame(rows, SCHEMA), "key", "text", "trusted").collect():
        found[r["place"]].add(r["key"])
    got = {frozenset(v) for v in found.values() if not any(k.startswith("f:") for k in v)}
    assert got == {frozenset(f"c:{i}.{k}" for k in range(len(g))) for i, g in enumerate(groups)}
