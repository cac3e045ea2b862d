"""Languages of documents and of each stretch of mixed documents, with a confidence.

The classifier is a sparse multinomial logistic regression on TF-IDF weighted character n-grams (hashed), trained by
follow-the-regularised-leader with an elastic net, then calibrated by one temperature. It is fitted on the driver, on a
bounded sample of labelled documents (``per_language`` documents of each language, ``sentences`` of each document); half
wrong labels do little harm, since sentences that one fit contradicts are left out of the next. The temperature is fitted
on all held-out sentences, whatever the model says of them, together with the share of wrong labels among them
(:func:`calibrate`). The model is a table of fixed size (``BUCKETS`` x languages), so its broadcast is bounded.

Applying it is one narrow Arrow-batched stage: texts are cut into sentences and lines, all n-grams of a batch are hashed
and summed with numpy, and each document's best sequence of languages is found by dynamic programming, which changes
language only for evidence that outweighs ``SWITCH``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "tr", "ru", "ar")
# Other codes and names of these languages.
LABELS = {
    "en": "eng english englisch anglais", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano",
    "it": "ita italian italiano", "pt": "por portuguese português portugues", "nl": "nld dut dutch nederlands", "tr": "tur turkish türkçe turkce", "ru": "rus russian русский", "ar": "ara arabic العربية",
}
BUCKETS = 1 << 18
ORDERS = (1, 2, 3, 4)
SCALE = 20.0
#: Temperature at which sentences weigh as evidence in the choice of stretches; confidences have the fitted one.
EVIDENCE = 0.25
#: Cost of changing language between two sentences, in nats of that evidence.
SWITCH = 4.0
#: A sentence of fewer letters counts in proportion.
FULL_LETTERS = 45
FLOOR = -12.0
#: n-grams summed at once.
CHUNK = 400_000

_LABEL = {name: code for code in LANGUAGES for name in (code, *LABELS[code].split())}


def label_language(label: str | None) -> str | None:
    """The language that a label names by any usual code or name, None if it names none of the ten."""
    if not label:
        return None
    word = label.strip().lower()
    return _LABEL.get(word) or _LABEL.get(re.split(r"[-_\s(]", word, maxsplit=1)[0])


_CUT = re.compile(r"(?<=[.!?؟…])[\"”»’)*]*\s+|\n\s*\n|\n(?![a-zà-öø-ÿа-яğışçöü])|\s/\s|\s\|\s(?=[A-ZÀ-ÞА-Я][^|]{40})")
_WORDS = re.compile(r"[^\W\d_]+")
_INVISIBLE = re.compile("[­​-‏⁠﻿]|-\n(?=[a-z])")


def units_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a text."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def speech(unit: str) -> str:
    """The words of a unit in lower case; '' if it is a name, a code or a table line, which have no language."""
    if unit.count("|") >= 2:
        return ""
    unit = _INVISIBLE.sub("", unit)
    words = _WORDS.findall(unit)
    if not words:
        return ""
    if any(w[0].islower() or w[0].isupper() for w in words):
        small = sum(w[0].islower() and len(w) > 1 for w in words)
        if small < 3 and not (len(words) >= 8):
            return ""
    elif len(words) < 3:
        return ""
    return " ".join(words).lower()


def grams(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, unit) of every n-gram of every unit; units are padded with one blank on either side."""
    padded = [f" {u} " for u in units]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(units)), [len(p) for p in padded])
    buckets, owners = [], []
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            same = owner[:size] == owner[n - 1 :]
            mixed = (rolled[same] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(46)).astype(np.int64) & (BUCKETS - 1))
            owners.append(owner[:size][same])
    return np.concatenate(buckets) if buckets else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


@dataclass
class Model:
    """``weights`` already hold idf and scale; ``idf`` normalises; both are of fixed size."""

    weights: np.ndarray
    idf: np.ndarray
    temperature: float
    wrong_labels: float = 0.0

    def scores(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), len(LANGUAGES)))
        at = 0
        while at < len(units):
            end, chars = at, 0
            while end < len(units) and (chars == 0 or chars + len(units[end]) * len(ORDERS) < CHUNK):
                chars += len(units[end]) * len(ORDERS)
                end += 1
            bucket, owner = grams(units[at:end])
            mass = np.bincount(owner, self.idf[bucket], end - at)
            # owners ascend within each order of n-grams: sum their runs, one row of weights an n-gram
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
            if len(first):
                np.add.at(out, at + owner[first], np.add.reduceat(self.weights[bucket], first, axis=0))
            out[at:end] /= np.maximum(mass, 1e-9)[:, None]
            at = end
        return out

    def log_probabilities(self, units: list[str]) -> np.ndarray:
        return _log_softmax(self.scores(units) / self.temperature)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _vectors(units: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    bucket, owner = grams(units)
    order = np.lexsort((bucket, owner))
    bucket, owner = bucket[order], owner[order]
    first = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(owner) != 0)])
    count = np.diff(np.r_[first, len(bucket)])
    b, o = bucket[first], owner[first]
    value = count * idf[b]
    mass = np.bincount(o, value, len(units))
    value = SCALE * value / np.maximum(mass[o], 1e-9)
    ends = np.searchsorted(o, np.arange(len(units) + 1))
    return [(b[s:e], value[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]


def _ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(weights, state) by per-coordinate follow-the-regularised-leader with an elastic net; goes on from a state."""
    z, n = state or (np.zeros((BUCKETS, len(LANGUAGES))), np.zeros((BUCKETS, len(LANGUAGES))))

    def weights(rows) -> np.ndarray:
        zz, nn = z[rows], n[rows]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(vectors)):
            rows, x = vectors[i]
            if not len(rows):
                continue
            w = weights(rows)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    return weights(slice(None)), (z, n)


#: Temperatures tried by :func:`calibrate`.
TEMPERATURES = tuple(np.geomspace(0.02, 20, 200).tolist())


def calibrate(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(temperature, share of wrong labels) for the labels of held-out sentences.

    The share of wrong labels is that among the half of the sentences with the clearest scores, where the model hardly
    errs. Given it, the temperature is the one under which the labels of all sentences, those that the model gets wrong
    above all, are most likely: a label is that of the sentence's language or, with that share, any other. A log-normal
    prior about 1, as heavy as one sentence, keeps the temperature from either end where the sentences leave it open.
    """
    if not len(labels):
        return 1.0, 0.0
    two = np.sort(scores, axis=1)[:, -2:]
    clear = np.argsort(two[:, 0] - two[:, 1], kind="stable")[: (len(labels) + 1) // 2]
    wrong = float((scores[clear].argmax(axis=1) != labels[clear]).mean())
    at = np.arange(len(labels))

    def loss(t: float) -> float:
        own = np.exp(_log_softmax(scores / t)[at, labels])
        return -np.log((1 - wrong) * own + wrong * (1 - own) / (scores.shape[1] - 1) + 1e-12).sum() + np.log(t) ** 2 / 2

    return min(TEMPERATURES, key=loss), wrong


def train(sentences: list[tuple[str, str]], epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 7) -> Model:
    """Fit on (language, words) pairs, of which some labels may be wrong; a tenth is held out for the temperature."""
    # sentences, not their texts, are held out: each with the label it was given
    held_words = {w for _, w in sentences if zlib.crc32(w.encode(), seed) % 10 == 0}
    held = [(lang, w) for lang, w in sorted(sentences) if w in held_words]
    votes: dict[str, Counter] = {}
    for lang, words in sentences:
        if words not in held_words:
            votes.setdefault(words, Counter())[lang] += 1
    # the same words under several labels count once, under the most frequent one
    fitted = sorted((min(c, key=lambda x: (-c[x], x)), words) for words, c in votes.items() if 2 * max(c.values()) > sum(c.values()))
    if not fitted:
        return Model(np.zeros((BUCKETS, len(LANGUAGES)), np.float32), np.ones(BUCKETS, np.float32), 1.0)
    units = [u for _, u in fitted]
    labels = np.array([LANGUAGES.index(lang) for lang, _ in fitted])
    bucket, owner = grams(units)
    pairs = np.unique(owner * BUCKETS + bucket)
    frequency = np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    idf = np.log((1 + len(units)) / (1 + frequency)) + 1.0
    vectors = _vectors(units, idf)
    keep = np.ones(len(units), dtype=bool)
    for last in (False, False, True):
        use = np.flatnonzero(keep)
        w, state = _ftrl([vectors[i] for i in use], labels[use], epochs if last else 1, alpha, beta, l1, l2, seed)
        scores = np.array([x @ w[rows] for rows, x in vectors])
        keep = scores.argmax(axis=1) == labels  # the rest are wrong labels and foreign sentences
    fixed = idf.astype(np.float32)
    weighted = lambda x: (x * idf[:, None] * SCALE).astype(np.float32)
    held_labels = np.array([LANGUAGES.index(lang) for lang, _ in held], dtype=np.int64)
    held_scores = Model(weighted(w), fixed, 1.0).scores([u for _, u in held])
    temperature, wrong = calibrate(held_scores, held_labels)
    # once they have told the temperature, the held-out sentences that the model confirms are learned as well
    late = np.flatnonzero(held_scores.argmax(axis=1) == held_labels) if len(held) else []
    if len(late):
        more = _vectors([held[i][1] for i in late], idf)
        w, _ = _ftrl(more, held_labels[late], epochs, alpha, beta, l1, l2, seed, state)
    return Model(weighted(w), fixed, temperature, wrong)


def sample_sentences(documents: DataFrame, per_language: int, sentences: int, seed: int = 7) -> list[tuple[str, str]]:
    """(language, words) of a bounded sample: about ``per_language`` documents of each language, at most twice as many.

    Documents are drawn by a hash of their id, at a rate taken from the counts of labels over all documents.
    """
    code = F.create_map(*[F.lit(x) for pair in _LABEL.items() for x in pair])
    word = F.lower(F.trim(F.col("lang")))
    labelled = documents.withColumn("_lang", F.coalesce(F.try_element_at(code, word), F.try_element_at(code, F.split(word, r"[-_\s(]")[0])))
    counts = {r["_lang"]: r["count"] for r in labelled.groupBy("_lang").count().collect() if r["_lang"]}
    if not counts:
        return []
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    drawn = labelled.where(F.col("_lang").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < F.try_element_at(rate, F.col("_lang")) * (1 << 20)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, lang, text in zip(batch["doc_id"], batch["_lang"], batch["text"], strict=True):
                spoken = [s for a, b in units_of(text) if (s := speech(text[a:b]))]
                chosen = np.random.default_rng(doc & 0x7FFFFFFF).permutation(len(spoken))[:sentences]
                out += [(lang, spoken[i]) for i in sorted(chosen)]
            yield pd.DataFrame(out, columns=["lang", "words"])

    rows = drawn.select(F.col("doc_id").cast("long").alias("doc_id"), "_lang", "text").where("text IS NOT NULL").mapInPandas(cut, "lang string, words string")
    most = 2 * per_language * sentences * len(LANGUAGES)
    return [(r["lang"], r["words"]) for r in rows.limit(most).collect()]


def fit_language_model(documents: DataFrame, per_language: int = 250, sentences: int = 8, **options) -> Model:
    return train(sample_sentences(documents, per_language, sentences), **options)


def stretches(logs: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The best language of each unit: dynamic programming over evidence and the cost of changing language."""
    emission = np.maximum(logs, FLOOR) * np.minimum(1.0, letters / FULL_LETTERS)[:, None]
    total, back = emission[0].copy(), np.zeros(emission.shape, dtype=np.int8)
    for i in range(1, len(emission)):
        best = int(total.argmax())
        change = total[best] - SWITCH
        stay = total >= change
        back[i] = np.where(stay, np.arange(len(total)), best)
        total = np.where(stay, total, change) + emission[i]
    path = np.empty(len(emission), dtype=np.int64)
    path[-1] = total.argmax()
    for i in range(len(emission) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def label_languages(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_given, seg_ix, lang, confidence, start, end): one row per maximal stretch in one language.

    ``start`` and ``end`` are character offsets. Names, codes and table lines belong to no stretch of their own. Null,
    empty and blank texts and texts without any speech give no rows; null labels are kept. Whole texts are read, however
    long. Ties between languages go to the first in ``LANGUAGES``; repeated rows give repeated results; an empty table
    gives an empty result; other columns are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang_given", "seg_ix", "lang", "confidence", "start", "end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            spans, spoken, counts = [], [], []
            for text in batch["text"]:
                own = [(a, b, s) for a, b in units_of(text or "") if (s := speech(text[a:b]))]
                spans += [(a, b) for a, b, _ in own]
                spoken += [s for _, _, s in own]
                counts.append(len(own))
            scores = known.scores(spoken)
            logs, sure = _log_softmax(scores / EVIDENCE), np.exp(_log_softmax(scores / known.temperature))
            letters = np.array([len(s) - s.count(" ") for s in spoken], dtype=float)
            out, at = [], 0
            for doc, given, n in zip(batch["doc_id"], batch["lang"], counts, strict=True):
                if n:
                    path = stretches(logs[at : at + n], letters[at : at + n])
                    first = np.flatnonzero(np.r_[True, np.diff(path) != 0])
                    for k, (s, e) in enumerate(zip(first, np.r_[first[1:], n], strict=True)):
                        out.append((doc, given, k, LANGUAGES[path[s]], float(np.average(sure[at + s : at + e, path[s]], weights=letters[at + s : at + e])), spans[at + s][0], spans[at + e - 1][1]))
                at += n
            yield pd.DataFrame(out, columns=names)

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return source.mapInPandas(run, "doc_id long, lang_given string, seg_ix int, lang string, confidence double, start int, end int")
