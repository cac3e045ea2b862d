import random

import numpy as np

from waybill.llm.leakage import Aligner, FMIndex, Items, _local, find_passages, merge_spans, suffix_array, words_of

WORDS = [f"{a}{b}" for a in "ba be bi bo bu da de di do du fa fe".split() for b in "ra re ri ro ru sa se si so su".split()]


def passage(seed, n):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def test_suffix_array_and_search_against_scan():
    rng = np.random.default_rng(3)
    for n, k in ((1, 2), (50, 2), (400, 3), (300, 30)):
        text = rng.integers(0, k, n)
        index = FMIndex(text, k)
        full = np.r_[text + 1, 0]
        assert suffix_array(full).tolist() == sorted(range(len(full)), key=lambda i: full[i:].tolist())
        phrases = rng.integers(0, k, (40, 3))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(n - 2) if (text[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_words_fold_typography():
    assert words_of("The **half-**trained sta-\nbi­lity co​ordinator’s ﬁle") == ["the", "half", "trained", "stability", "coordinators", "file"]


def test_passages_spans_and_edges(spark):
    items = {i: passage(i, 60) for i in range(1, 6)}
    noise = lambda s, n: " ".join(passage(1000 + s, n))
    changed = items[2][10:40]
    changed[5:6] = ["zzz"]
    del changed[15]
    docs = [
        (1, noise(1, 50) + ". " + " ".join(items[1]) + ". " + noise(2, 50)),
        (2, noise(3, 30) + " " + " ".join(w.upper() for w in changed) + "! " + noise(4, 200)),
        (3, noise(5, 40) + " " + " ".join(items[3][:10]) + " " + noise(6, 40)),
        (4, noise(7, 2000)),
        (5, None), (6, ""), (7, "xyz " * 50_000 + " ".join(items[4][20:45]) + " abc" * 50_000),
        (8, " ".join(items[5]) + " qq ww ee rr " + " ".join(items[5])), (8, " ".join(items[5]) + " qq ww ee rr " + " ".join(items[5])),
    ]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([*[(i, "s", " ".join(w)) for i, w in items.items()], (9, "s", None), (10, "s", "a b")], "item_id long, suite string, text string")
    got = find_passages(d, e).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2), (7, 4), (8, 5)}
    assert sum(r["doc_id"] == 8 for r in got) == 4
    text = docs[0][1]
    first = next(r for r in got if r["doc_id"] == 1)
    assert words_of(text[first["start"] : first["end"]]) == items[1]
    assert {(r["doc_id"], r["item_id"]) for r in find_passages(d, e, limit=1000).collect()} == {(1, 1), (2, 2), (7, 4), (8, 5)}
    assert find_passages(d.limit(0), e).count() == 0 and find_passages(d, e.limit(0)).count() == 0
    spans = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 12), (1, 3, 20, 30), (1, 4, 5, 8)], "doc_id long, item_id long, start int, end int")
    assert [(r["start"], r["end"], r["items"]) for r in merge_spans(spans).orderBy("start").collect()] == [(0, 12, [1, 2, 4]), (20, 30, [3])]


def test_items_without_phrases():
    assert Items.of([]).phrases.shape[0] == 0


def test_short_items_and_passages_with_few_words_intact(spark):
    item = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    changed = [f"x{w}" if k % 4 == 3 and k != 19 else w for k, w in enumerate(item)]
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two three four five six"), (3, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "say alpha beta gamma delta now"), (2, "one two three four five six"), (3, "one two three four five seven"), (4, "before " + " ".join(changed) + " after")], "doc_id long, text string")
    found = lambda **more: sorted((r["doc_id"], r["item_id"], r["item_start"], r["item_end"]) for r in find_passages(docs, items, **more).collect())
    assert found(floor=6) == [(1, 1, 0, 4), (2, 2, 0, 6), (4, 3, 0, 39)]
    assert found() == [(1, 1, 0, 4), (2, 2, 0, 6), (3, 2, 0, 5), (4, 3, 0, 39)]  # five of six words are over a quarter


def test_recall_by_length_and_rate_of_change_and_the_floor(spark):
    """Every passage with a quarter of the item's words, however short the item, every fifth to eighth word changed."""
    items = {n: passage(n, n) for n in (3, 6, 20, 60, 150)}
    docs, want = [], set()
    for n, words in items.items():
        for part in (0.25, 1 / 3, 0.5, 1.0):
            for every in (0, 5, 6, 7, 8):
                stretch = list(words[: max(4, -int(-n * part // 1))])
                if n == 3 and (part < 1 or every):
                    continue
                stretch = [f"zz{k}" if every and k % every == every - 1 else w for k, w in enumerate(stretch)]
                docs.append((len(docs), f"{' '.join(passage(500 + len(docs), 40))} - {' '.join(stretch)} - {' '.join(passage(900 + len(docs), 40))}"))
                if sum(not w.startswith("zz") for w in stretch) >= n / 4 or n == 3:
                    want.add((docs[-1][0], n))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_passages(d, e).collect()}
    assert got == want and len(want) > 60
    high = {(r["doc_id"], r["item_id"]) for r in find_passages(d, e, floor=11).collect()}
    assert high < want and not any(n == 20 for doc, n in high if len(docs[doc][1].split(" - ")[1].split()) < 11)


def test_bound_loses_no_alignment():
    rng = np.random.default_rng(11)
    for _ in range(300):
        item, text = rng.integers(1, 12, 30), rng.integers(0, 14, 60)
        score, matches, i, j = _local(item, text)
        for needed in (score, score + 1):
            found = Aligner(12).aligned(item, text, needed)
            assert (found is None) == (score < needed or score <= 0)
        assert 0 < matches <= min(i, j) and score <= matches
