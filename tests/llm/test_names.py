import random

import pytest

from waybill.llm.names import distances, encode, link_names, metric_join, one_edit, pairs_of_names, take_apart, within


def plain_distance(a, b):
    """Unrestricted Damerau-Levenshtein by the textbook table."""
    far = len(a) + len(b)
    last, h = {}, [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        h[i + 1][1] = i
    for j in range(len(b) + 1):
        h[1][j + 1] = j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            i1, j1 = last.get(b[j - 1], 0), seen
            cost = a[i - 1] != b[j - 1]
            if not cost:
                seen = j
            h[i + 1][j + 1] = min(h[i][j] + cost, h[i + 1][j] + 1, h[i][j + 1] + 1, h[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    return h[-1][-1]


def random_words(n, letters, longest, seed):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_distances_against_the_textbook():
    for letters in ("ab", "abc", "abcdef"):
        many = random_words(150, letters, 8, len(letters))
        for one in random_words(12, letters, 8, 99):
            assert distances(one, *encode(many)).tolist() == [plain_distance(one, x) for x in many]
            assert [one_edit(one, x) for x in many] == [plain_distance(one, x) <= 1 for x in many]
    long = "ab" * 80
    assert distances(long, *encode([long, long[1:]])).tolist() == [0, 1]


@pytest.mark.parametrize("radius", [1, 2])
def test_metric_join_against_all_pairs(spark, radius):
    words = list(dict.fromkeys(w for w in random_words(700, "abcd", 9, 5) if w))
    got = metric_join(spark.createDataFrame([*enumerate(words), (None, "x"), (9999, None)], "id long, s string"), radius, per_pivot=20)
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if plain_distance(words[i], words[j]) <= radius}
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    assert set(within(words[:80], list(range(80)), radius)) == {(a, b) for i, j in want if j < 80 for a, b in ((i, j), (j, i))}


def test_parts():
    p = take_apart("M/s Debikofa Pharmaceutical Penosu Private Limited (Head Office)")
    assert (p.words, p.business, p.form) == (("debikofa", "penosu"), "pharmaceuticals", "private limited")
    assert take_apart("CORPORATION GEGONURU B. HEALTH CARE PROD.").words == ("gegonuru", "b")
    assert take_apart("").words == ()


SAME = [["Bagikami Dorime Biotechnology Limited", "Bagikami-Doorime Biotechnology Limited (BDB)", "Bagikami Dorime Biotechn. _ Bagidori", "M/S. BAGIKAMI D. BIOTECH LTD", "Dorime, Bagikami Biotechnology Limited", "Bagikamidorime Biotech Limited", "Bagikami Biotechnology Limited", "Bagkiami Dorime Biotechnology Ltd"], ["Legudoli Gumira Pharmaceutical Industries GmbH", "LEGUDOLI G. PHARMA IND. GMBH"], ["Legudoli Nebate Pharmaceutical Industries Private Limited", "Legudoli Nebate Pharm. Industries Pvt. Ltd."], ["Legudoli Pharma"]]


def test_links_and_edges(spark):
    names = [(n, "x") for group in SAME for n in group] * 2 + [(None, "x"), ("", None), ("  ", ""), ("Q" * 20_000, "")]
    got = link_names(spark.createDataFrame(names, "name string, entity string"))
    entity = {r["name"]: r["entity"] for r in got.collect()}
    assert len(entity) == sum(map(len, SAME)) + 1
    groups = [{entity[n] for n in g} for g in SAME]
    assert all(len(g) == 1 for g in groups) and len(set().union(*groups)) == 4
    assert pairs_of_names(got).count() == 28 + 1 + 1
    assert link_names(spark.createDataFrame([], "name string")).count() == 0


def test_short_names_initials_and_other_scripts(spark):
    groups = [
        ["Dami Rogu Trading", "Damo Rogu Trading LLC", "Rogu Dami Trading"], ["Dami Rogu Laboratories"],
        ["K. Bagikami Dorime Biotechnology", "K. Bagikami Doreme Biotechnology"], ["M. Bagikamo Dorima Biotechnology"],
        ["Терлюмин Варкоста Trading", "Терлюмин Варкаста Trading"], ["Гумиропек Лафаторин Trading"], ["北京博康 Trading"], ["南京博康 Trading"],
        ["Tivelo Sorbanek Wugimar Trading", "Wugimar Trading"],
    ]
    found = {r["name"]: r["entity"] for r in link_names(spark.createDataFrame([(x,) for g in groups for x in g], "name string")).collect()}
    assert [len({found[x] for x in g}) for g in groups] == [1] * len(groups)
    assert len(set(found.values())) == len(groups)


def test_single_words_reordered_words_and_names_without_latin_letters(spark):
    groups = [
        ["Pfizer GmbH", "Pfiser GmbH"], ["Bayer AG"], ["Beyer AG"], ["Siemens AG", "SIEMENS", "Simens AG"], ["Al Noor Medical Supplies", "Alnoor Medical Supplies"],
        ["Kramer Weiss Hofmann Pharma Ltd", "Weiss Kramer Hofmann Pharma", "Hofmann Weiss Kramar Pharma Ltd"],
        ["Газпром", "Газпром Ltd"], ["Лукойл"], ["شركة النور"], ["株式会社"], ["有限公司"], ["Pfizerr Trading"], ["Novartis"],
    ]
    found = {r["name"]: r["entity"] for r in link_names(spark.createDataFrame([(x,) for g in groups for x in g], "name string")).collect()}
    assert [len({found[x] for x in g}) for g in groups] == [1] * len(groups)
    assert len(set(found.values())) == len(groups)


def test_large_cells_and_large_entities_give_the_same(spark):
    words = list(dict.fromkeys(w for w in random_words(400, "abcd", 9, 8) if w))
    points = spark.createDataFrame([*enumerate(words)], "id long, s string")
    for radius in (1, 2):
        assert set(metric_join(points, radius, most=5).collect()) == set(metric_join(points, radius).collect())
    entities = spark.createDataFrame([(f"n{i:03}", i // 90) for i in range(200)], "name string, entity long")
    assert set(pairs_of_names(entities, per_salt=7).collect()) == {(f"n{i:03}", f"n{k:03}") for i in range(200) for k in range(i + 1, 200) if i // 90 == k // 90}


def test_distances_of_letters_beyond_latin():
    assert distances("гумир", *encode(["гумир", "гумар", "лафат", "ab"])).tolist() == [0, 1, 5, 5]
    assert distances("ab", *encode(["гб", "ab"])).tolist() == [2, 0]


def test_one_edit_joins_without_distances_to_pivots(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("pivots were drawn")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    random.seed(8)
    words = sorted({"".join(random.choice("aabbc") for _ in range(random.randint(1, 7))) for _ in range(250)} | {"名称", "名", "称名", "x" * 300, "x" * 299, "ßü", "üß"})
    got = metric_join(spark.createDataFrame([*enumerate(words), (500, words[0]), (None, "a"), (501, ""), (502, None)], "id long, s string"))
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if plain_distance(words[i], words[j]) <= 1} | {(0, 500)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
