"""Evaluation passages inside a corpus, found with one full-text index per shard of the corpus.

Each task cuts its documents into shards and builds an FM-index of a shard over words: a suffix array, the
Burrows-Wheeler transform of it, a wavelet matrix for ranks and every ``SAMPLE``-th suffix position. All short phrases
of the test items are searched backwards at once, vectorised over phrases; their occurrences are located by walking to
sampled positions. The text around occurrences of one item is then aligned with it word by word, which bridges small
changes of wording, unless a bound shows that no alignment there can be good enough; what the alignment covers becomes
a span; the spans of a document are merged for removal.

Documents never leave their task: no shuffle, no join, memory bounded by the shard (or one document, if longer). The
test items are broadcast behind a check of their size; items beyond the bound are searched in several passes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.session import BROADCAST_LIMIT

#: Words of a phrase searched in the index.
PHRASE = 4
#: Every so many suffix positions are kept.
SAMPLE = 8
#: Words of a shard.
SHARD = 1 << 18
#: Score of a passage (matches less changes), as a share of the stretch of the item that it covers, at least.
LEAST_LIKENESS = 0.45

_INVISIBLE = "­​‌‍⁠﻿"
WORD = re.compile(rf"[^\W_]+(?:(?:[{_INVISIBLE}]+(?:-\n)?|-\n(?=[^\W\d_])|['’])[^\W_]+)*", re.U)
_JOINTS = re.compile(rf"[{_INVISIBLE}'’\n-]+")


def word_of(raw: str) -> str:
    """A word as it is compared: case, typography, hyphenation and ligatures folded."""
    if raw.isascii() and raw.isalnum():
        return raw.lower()
    return _JOINTS.sub("", unicodedata.normalize("NFKC", raw)).casefold()


def words_of(text: str) -> list[str]:
    return [word_of(w) for w in WORD.findall(text)]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the smallest and unique."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks over a sequence of small integers, in one array of counts per bit."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for b in range(bits - 1, -1, -1):
            bit = (sequence >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.first = self._down(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self.ones[level][at]
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._down(symbol, at) - self.first[symbol]


class FMIndex:
    """A full-text index of one shard; symbol 0 ends the text and stands for words that no item has."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.r_[text.astype(np.int64) + 1, 0]  # a unique smallest end
        sa = suffix_array(text)
        self.size = len(text)
        bwt = text[sa - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(symbols + 1).bit_length()))
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=(1 << self.wavelet.bits)))]
        self.bwt = bwt
        self.sampled = sa % SAMPLE == 0
        self.sample_rank = np.r_[0, np.cumsum(self.sampled)]
        self.samples = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows of each phrase (one a line), by backward search of all at once."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k].astype(np.int64) + 1
            low = self.before[symbol] + self.wavelet.rank(symbol, low)
            high = self.before[symbol] + self.wavelet.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: each walks back to a sampled row."""
        rows, out, walked = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows[left]]
            at = left[done]
            out[at] = self.samples[self.sample_rank[rows[at]]] + walked[at]
            left = left[~done]
            symbol = self.bwt[rows[left]]
            rows[left] = self.before[symbol] + self.wavelet.rank(symbol, rows[left])
            walked[left] += 1
        return out


@dataclass
class Items:
    """The test items as word numbers, and every phrase of them with where it stands."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    phrases: np.ndarray = field(default_factory=lambda: np.zeros((0, PHRASE), np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    places: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    #: Items shorter than a phrase, by their number of words: (places of the items, their words, one a line).
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        vocabulary: dict[str, int] = {}
        ids, words = [], []
        for item, text in rows:
            own = words_of(text)
            if not own:
                continue
            ids.append(item)
            words.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in own], dtype=np.int64))
        items = cls(ids, words, vocabulary)
        for n in range(1, PHRASE):
            at = np.array([i for i, w in enumerate(words) if len(w) == n], dtype=np.int64)
            if len(at):
                items.short[n] = at, np.stack([words[i] for i in at])
        grams = [(tuple(w[k : k + PHRASE]), i, k) for i, w in enumerate(words) for k in range(len(w) - PHRASE + 1)]
        grams.sort()
        if grams:
            keys = np.array([g for g, _, _ in grams])
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            items.phrases, items.starts = keys[new], np.r_[new, len(grams)]
            items.places = np.array([(i, k) for _, i, k in grams])
        return items


#: A match weighs so much more than a count of matches, which is carried in the digits below it.
_UNIT = 1 << 20


def _local(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of two word sequences: (score, matches, end in a, end in b); 1 a match, -1 a change, a gap or a word more."""
    m = len(b)
    ramp = np.arange(1, m + 1, dtype=np.int64) * _UNIT
    row, best = np.zeros(m + 1, dtype=np.int64), (0, 0, 0)
    gains = {symbol: np.where(b == symbol, _UNIT + 1, -_UNIT) for symbol in set(a.tolist())}
    for i, symbol in enumerate(a.tolist()):
        t = row[:-1] + gains[symbol]
        np.maximum(t, row[1:] - _UNIT, out=t)
        np.maximum(t, 0, out=t)
        t += ramp
        np.maximum.accumulate(t, out=t)
        np.subtract(t, ramp, out=row[1:])
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    # the score counts whole units, the matches are what is left of them
    return best[0] // _UNIT, best[0] % _UNIT, best[1], best[2]


def _most(hits: np.ndarray) -> int:
    """Largest sum of a stretch of +1 for a hit and -1 for none."""
    if not len(hits):
        return 0
    total = np.cumsum(np.where(hits, 1, -1))
    return int((total - np.minimum(np.minimum.accumulate(total), 0)).max())


class Aligner:
    """Alignments of items with stretches of text that can't miss one good enough, most of them without aligning.

    A word of the text that the item doesn't have costs the alignment one, wherever it stands inside, and a word that it
    has gains one at most; the same holds the other way round. So no alignment scores more than the best stretch of
    either side under +1 and -1, and only where both reach what is needed is anything aligned.
    """

    def __init__(self, symbols: int):
        self.marked = np.zeros(symbols + 2, dtype=bool)

    def _bound(self, words: np.ndarray, of: np.ndarray) -> int:
        self.marked[of] = True
        self.marked[0] = False
        out = _most(self.marked[words])
        self.marked[of] = False
        return out

    def aligned(self, item: np.ndarray, text: np.ndarray, needed: float) -> tuple[int, int, int, int, int, int] | None:
        """(score, matches, item start, item end, text start, text end) of the best local alignment, None if it scores less than needed."""
        if self._bound(text, item) < needed or self._bound(item, text) < needed:
            return None
        score, _, i, j = _local(item, text)
        if score < needed or score <= 0:
            return None
        score, matches, back_i, back_j = _local(item[:i][::-1], text[:j][::-1])
        return score, matches, i - back_i, i, j - back_j, j


def _search_shard(texts: list[list[int]], items: Items, share: float, floor: int = 0) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document's place in the shard, item's place, item start, item end, first word, word after) of each passage."""
    symbols, token_of, doc_of, arrays = [], [], [], []
    for d, text in enumerate(texts):
        own = np.array(text, dtype=np.int64)
        arrays.append(own)
        keep = np.ones(len(own), dtype=bool)
        keep[1:] = (own[1:] != 0) | (own[:-1] != 0)  # a run of unknown words is one symbol
        at = np.flatnonzero(keep)
        symbols += [own[at], np.zeros(1, np.int64)]
        token_of += [at, np.array([len(own)])]
        doc_of += [np.full(len(at) + 1, d)]
    if not symbols:
        return
    text, tokens, docs = np.concatenate(symbols), np.concatenate(token_of), np.concatenate(doc_of)
    if len(text) < 2 or not items.ids:
        return
    index = FMIndex(text, len(items.vocabulary))
    for n, (at, phrases) in items.short.items():
        low, high = index.search(phrases)
        for i, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            position = index.locate(np.arange(a, b))
            yield from ((d, i, 0, n, t, t + n) for d, t in zip(docs[position].tolist(), tokens[position].tolist(), strict=True))
    if not len(items.phrases):
        return
    low, high = index.search(items.phrases)
    count = high - low
    found = np.flatnonzero(count)
    if not len(found):
        return
    rows = np.repeat(low[found] - np.r_[0, np.cumsum(count[found])[:-1]], count[found]) + np.arange(count[found].sum())
    position = index.locate(rows)
    phrase = np.repeat(found, count[found])
    # one line for each item that has the phrase
    many = items.starts[phrase + 1] - items.starts[phrase]
    place = np.repeat(items.starts[phrase] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    hit = np.stack([np.repeat(docs[position], many), items.places[place, 0], np.repeat(tokens[position], many), items.places[place, 1]], axis=1)
    hit = hit[np.lexsort((hit[:, 2], hit[:, 1], hit[:, 0]))]
    aligner = Aligner(len(items.vocabulary))
    group = np.flatnonzero(np.r_[True, (hit[1:, 0] != hit[:-1, 0]) | (hit[1:, 1] != hit[:-1, 1])])
    for s, e in zip(group, np.r_[group[1:], len(hit)], strict=True):
        d, i = int(hit[s, 0]), int(hit[s, 1])
        item = items.words[i]
        n = len(item)
        # words that must match, and the score that a passage with so many has at least
        least = min(n, max(floor, math.ceil(share * n)))
        needed = LEAST_LIKENESS * least
        # hits that can belong to one passage: apart by less than the item is long
        cut = np.flatnonzero(np.diff(hit[s:e, 2]) > n) + 1
        for a, b in zip(np.r_[0, cut], np.r_[cut, e - s], strict=True):
            part = hit[s + a : s + b]
            own = arrays[d]
            todo = [(max(0, int(part[0, 2]) - n), min(len(own), int(part[-1, 2]) + n + PHRASE))]
            while todo:
                x, y = todo.pop()
                if y - x < least or (best := aligner.aligned(item, own[x:y], needed)) is None:
                    continue
                score, matches, i0, i1, j0, j1 = best
                if matches < least or score < LEAST_LIKENESS * (i1 - i0):
                    continue
                yield d, i, i0, i1, x + j0, x + j1
                todo += [(x, x + j0), (x + j1, y)]  # the same item may be there again


def find_passages(documents: DataFrame, items: DataFrame, share: float = 0.25, floor: int = 0, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, item_id, item_start, item_end, start, end): every passage of an item in a document.

    A passage is a stretch of the item in order, small changes of wording and any of typography aside, of which at least
    ``share`` of the item's words match (``floor`` words, if that is more) and that scores, at 1 a match and -1 a change,
    at least ``LEAST_LIKENESS`` of its length. It is found by any ``PHRASE`` words in a row that are unchanged; without any
    (every fourth word changed) it is not found. Items of fewer than ``PHRASE`` words are found where they stand whole.
    ``item_start`` and ``item_end`` count words, ``start`` and ``end`` characters of the text.

    Null and empty texts and items without words give nothing; very long texts are read whole, in one shard of their
    own; an item that stands in a document twice gives two rows; repeated documents give repeated rows; other columns of
    either table are left out; empty tables give an empty result.
    """
    usable = items.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # the index of the phrases takes about 16 bytes a character; as many passes as bounded parts, none collected before it is counted
    characters = usable.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = 1 + 16 * characters // limit
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    passes = (Items.of([(r["item_id"], r["text"]) for r in usable.where(part_of == k).orderBy("item_id").collect()]) for k in range(parts))
    spark = documents.sparkSession
    out = None
    for part in passes:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = shared.value
            get = own.vocabulary.get
            names = ["doc_id", "item_id", "item_start", "item_end", "start", "end"]

            def flush(held: list[tuple[int, str, list[int]]]) -> pd.DataFrame:
                rows, spans = [], {}
                for d, i, i0, i1, w0, w1 in _search_shard([w for _, _, w in held], own, share, floor):
                    if d not in spans:
                        spans[d] = [m.span() for m in WORD.finditer(held[d][1])]
                    rows.append((held[d][0], own.ids[i], i0, i1, spans[d][w0][0], spans[d][w1 - 1][1]))
                return pd.DataFrame(rows, columns=names)

            held, size = [], 0
            for batch in batches:
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    words = [get(word_of(w), 0) for w in WORD.findall(text)]
                    held.append((doc, text, words))
                    size += len(words)
                    if size >= SHARD:
                        yield flush(held)
                        held, size = [], 0
            if held:
                yield flush(held)

        source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
        found = source.mapInPandas(run, "doc_id long, item_id long, item_start int, item_end int, start int, end int")
        out = found if out is None else out.unionByName(found)
    return out


def merge_spans(passages: DataFrame) -> DataFrame:
    """(doc_id, start, end, items): the disjoint spans to remove from each document, with the items they leak.

    Spans that overlap or touch become one. Grouped by document; a document's spans are few.
    """
    spans = passages.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "item_id"))).alias("s"))
    fold = """
        aggregate(s, cast(array() as array<struct<start: int, end: int, items: array<bigint>>>), (acc, x) ->
            if(size(acc) > 0 AND element_at(acc, -1).end >= x.start,
               concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end), 'items', array_union(element_at(acc, -1).items, array(x.item_id))))),
               concat(acc, array(named_struct('start', x.start, 'end', x.end, 'items', array(x.item_id))))))
    """
    return spans.select("doc_id", F.inline(F.expr(fold))).select("doc_id", "start", "end", F.array_sort("items").alias("items"))
