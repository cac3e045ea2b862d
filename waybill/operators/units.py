"""Quantities in many units and notations, brought to micrograms and microlitres.

A unit string is segmented by dynamic programming over tries: one of prefixes (``k``, ``milli`` ...), one of roots
(``g``, ``litre``, ``lb``, ``m`` ...) and one of exponents, which stand before (``cubic``, ``cu``) or after (``3``, ``³``)
a root of length, besides plural endings. Ambiguous decompositions (``mt``: metric ton or metre, ``gr``: gram or grain,
``Mg``: milligram or megagram) are scored by the costs of their parts and by a prior on the dimension and the scale that
a field has. Sentences about amounts (``20 DRUMS OF 5 kg NET EACH``) are read by a small grammar over the numbers and
units found in them; numbers follow the site's decimal mark. Arithmetic is exact (fractions).

The operator is one narrow Arrow-batched stage with a bounded memo per worker; no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping
from fractions import Fraction
from functools import lru_cache, wraps

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prefixes and their powers of ten; long ones go with long roots, short ones with short roots.
LONG_PREFIXES = {"micro": -6, "milli": -3, "centi": -2, "deci": -1, "deca": 1, "deka": 1, "hecto": 2, "kilo": 3, "mega": 6}
SHORT_PREFIXES = {"u": -6, "µ": -6, "mc": -6, "m": -3, "c": -2, "d": -1, "da": 1, "h": 2, "k": 3}
#: Prefixes that only a capital letter can mean.
CAPITAL_PREFIXES = {"M": 6}
# Roots as (dimension, size in micrograms, microlitres or metres, cost of reading a text so).
LONG_ROOTS = {
    "gram": ("mass", 10**6, 0), "gramme": ("mass", 10**6, 0), "gramm": ("mass", 10**6, 0), "gramo": ("mass", 10**6, 0), "grama": ("mass", 10**6, 0),
    "litre": ("volume", 10**6, 0), "liter": ("volume", 10**6, 0), "litro": ("volume", 10**6, 0),
}
SHORT_ROOTS = {
    "g": ("mass", 10**6, 0), "gm": ("mass", 10**6, 0), "gr": ("mass", 10**6, 0),
    "l": ("volume", 10**6, 0), "lt": ("volume", 10**6, 0), "ltr": ("volume", 10**6, 0),
}
_POUND, _INCH, _GALLON = 453_592_370, Fraction(254, 10_000), Fraction(3_785_411_784, 1000)
WHOLE_ROOTS = {
    "kilo": ("mass", 10**9, 0), "kgm": ("mass", 10**9, 0), "kgr": ("mass", 10**9, 0),
    "t": ("mass", 10**12, 0), "to": ("mass", 10**12, 1), "tne": ("mass", 10**12, 0), "ton": ("mass", 10**12, 0), "tonne": ("mass", 10**12, 0), "mt": ("mass", 10**12, 0), "mton": ("mass", 10**12, 0), "metricton": ("mass", 10**12, 0), "metrictonne": ("mass", 10**12, 0), "tonmetric": ("mass", 10**12, 0), "tonnemetric": ("mass", 10**12, 0),
    "lb": ("mass", _POUND, 0), "pound": ("mass", _POUND, 0), "lbr": ("mass", _POUND, 0),
    "oz": ("mass", Fraction(_POUND, 16), 0), "ounce": ("mass", Fraction(_POUND, 16), 0),
    "cwt": ("mass", 112 * _POUND, 0), "hundredweight": ("mass", 112 * _POUND, 0), "grain": ("mass", Fraction(_POUND, 7000), 0), "gr": ("mass", Fraction(_POUND, 7000), 3),
    "cc": ("volume", 10**3, 0), "gal": ("volume", _GALLON, 0), "gallon": ("volume", _GALLON, 0), "qt": ("volume", _GALLON / 4, 0), "quart": ("volume", _GALLON / 4, 0), "pt": ("volume", _GALLON / 8, 0), "pint": ("volume", _GALLON / 8, 0),
    "floz": ("volume", _GALLON / 128, 0), "fluidounce": ("volume", _GALLON / 128, 0), "usgal": ("volume", _GALLON, 0), "impgal": ("volume", 4_546_090, 0), "imperialgallon": ("volume", 4_546_090, 0),
}
LENGTHS = {
    "metre": ("length", 1, 0), "meter": ("length", 1, 0), "metro": ("length", 1, 0), "m": ("length", 1, 0), "mtr": ("length", 1, 0), "mt": ("length", 1, 0),
    "in": ("length", _INCH, 0), "inch": ("length", _INCH, 0), "ft": ("length", 12 * _INCH, 0), "foot": ("length", 12 * _INCH, 0), "feet": ("length", 12 * _INCH, 0),
}
# Exponents before and after a root of length.
EXPONENTS_BEFORE = {"cubic": 3, "cu": 3, "cb": 3, "c": 3, "square": 2, "sq": 2}
EXPONENTS_AFTER = {"3": 3, "2": 2, "cubed": 3, "cubo": 3, "cube": 3}
ENDINGS = {"": 0, "s": 0, "es": 1, "n": 1}
# Words for packages and pieces, which measure nothing.
PACKAGES = frozenset("drum drums bag bags box boxes carton cartons ctn ctns fibre fiber vial vials pcs pc piece pieces pack packs pallet pallets can cans bottle bottles case cases keg kegs tin tins sack sacks unit units ampoule ampoules jar jars".split())
# Numbers as words.
NUMBERS = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {w: 10 * k for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100, "thousand": 1000, "million": 10**6}
_VULGAR = {c: Fraction(unicodedata.numeric(c)).limit_denominator(100) for c in "½¼¾⅓⅔⅛⅜⅝⅞⅕"}

#: What a field can't well be is dear: added to the cost of a decomposition by its dimension, and for a tonne's scale ("great").
PRIORS: dict[str, Mapping[str, int]] = {
    "quantity": {"mass": 0, "volume": 0, "length": 2, "area": 3, "great": 2},
    "weight": {"mass": 0, "volume": 1, "length": 4, "area": 4, "great": 2},
    "bulk": {"mass": 0, "volume": 0, "length": 3, "area": 3, "great": -2},
    "length": {"mass": 3, "volume": 3, "length": 0, "area": 1, "great": 0},
}
#: Sizes from which a reading by prefix is of a tonne's scale.
GREAT = 10**12
#: Texts longer than this aren't kept in memos.
MEMO = 256


def memo(function: Callable) -> Callable:
    """A bounded memo that long texts pass by, so that its memory is bounded as well."""
    kept = lru_cache(65_536)(function)

    @wraps(function)
    def call(text: str, *more):
        return kept(text, *more) if len(text) <= MEMO else function(text, *more)

    return call


def _trie(entries: Mapping[str, object]) -> dict:
    root: dict = {}
    for text, value in entries.items():
        node = root
        for c in text:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(value)
    return root


_TRIES = {
    "long prefix": _trie(LONG_PREFIXES), "short prefix": _trie(SHORT_PREFIXES), "capital prefix": _trie(CAPITAL_PREFIXES),
    "long root": _trie(LONG_ROOTS), "short root": _trie(SHORT_ROOTS), "whole root": _trie(WHOLE_ROOTS), "length root": _trie(LENGTHS),
    "before": _trie(EXPONENTS_BEFORE), "after": _trie(EXPONENTS_AFTER), "ending": _trie({k: v for k, v in ENDINGS.items() if k}),
}
_PREFIXED = [("long prefix", "long", 1), ("short prefix", "short", 1), ("capital prefix", "short", 2)]
#: What may follow what: state -> (trie, next state, cost). After "cubic" only a length can come.
_GRAMMAR = {
    "start": [*_PREFIXED, ("long root", "end", 0), ("short root", "end", 0), ("whole root", "end", 0), ("length root", "end", 0), ("before", "raised", 0)],
    "raised": [("long prefix", "raised again", 1), ("short prefix", "raised again", 1), ("length root", "end", 0)],
    "raised again": [("length root", "end", 0)],
    "long": [("long root", "end", 0), ("short root", "end", 2), ("length root", "end", 0)],
    "short": [("short root", "end", 0), ("long root", "end", 2), ("length root", "end", 0)],
    "end": [("ending", "ended", 0), ("after", "done", 0)],
    "ended": [("after", "done", 0)],
}


def _matches(trie: dict, text: str, at: int) -> Iterator[tuple[int, object]]:
    node = trie
    for k in range(at, len(text)):
        node = node.get(text[k])
        if node is None:
            return
        for value in node.get("", ()):
            yield k + 1, value


@memo
def measure(unit: str, field: str = "quantity") -> tuple[str, Fraction] | None:
    """(dimension, size in micrograms, microlitres, metres or square metres) of a unit's text, None if it is none.

    Dynamic programming over (position, state); the cheapest decomposition of the whole text wins, ties go to the one
    found with the longest root. Case counts for prefixes that are capital letters; text that is all capitals may mean either.
    """
    cased = re.sub(r"[^0-9A-Za-zµ]+", "", unicodedata.normalize("NFKD", unit).replace("μ", "µ"))
    text = cased.lower()
    if not text:
        return None
    prior = PRIORS.get(field, PRIORS["quantity"])
    # by position, then state: (cost, power of ten, exponent, -length of the root, root)
    best: dict[int, dict[str, list[tuple[int, int, int, int, tuple | None]]]] = {0: {"start": [(0, 0, 1, 0, None)]}}
    for at in range(len(text)):
        if at not in best:
            if max(best) < at:
                return None  # nothing reaches further
            continue
        for state, found in list(best[at].items()):
            for name, then, extra in _GRAMMAR.get(state, ()):
                for end, value in _matches(_TRIES[name], cased if name == "capital prefix" else text, at):
                    for cost, power, exponent, long, root in found:
                        if name.endswith("prefix"):
                            new = (cost + extra, power + value, exponent, long, root)
                        elif name.endswith("root"):
                            new = (cost + extra + value[2], power, exponent, long - (end - at), value)
                        elif name in ("before", "after"):
                            if name == "after" and (root[0] != "length" or exponent > 1):
                                continue
                            new = (cost + extra, power, value, long, root)
                        else:
                            new = (cost + extra + value, power, exponent, long, root)
                        best.setdefault(end, {}).setdefault(then, []).append(new)
    options = []
    for state in ("end", "ended", "done"):
        for cost, power, exponent, long, root in best.get(len(text), {}).get(state, ()):
            dim, size = root[0], Fraction(root[1]) * Fraction(10) ** power
            if dim == "length" and exponent > 1:
                dim, size = ("volume", size**3 * 10**9) if exponent == 3 else ("area", size**2)
            great = prior["great"] if power >= 6 and dim in ("mass", "volume") and size >= GREAT else 0
            options.append((cost + prior[dim] + great, long, dim, size))
    return min(options)[2:] if options else None


def segment(unit: str, field: str = "quantity") -> tuple[str, Fraction] | None:
    """As :func:`measure`, masses and volumes only."""
    found = measure(unit, field)
    return found if found and found[0] in ("mass", "volume") else None


_GROUPS = r"[   '’.,]"
_NUMBER = re.compile(rf"\d+(?:{_GROUPS}\d{{2,3}})*(?:[.,]\d+)?")


def _fraction(whole: str, tail: str = "") -> Fraction:
    """Of digits; more than 300 of them are beyond any total, or below any unit, that a BIGINT can tell."""
    whole = whole.lstrip("0")
    return Fraction(10) ** 300 if len(whole) > 300 else Fraction(f"{whole or 0}.{tail[:300] or 0}")


def number(text: str, decimal: str) -> Fraction | None:
    """The value of a printed number at a site with that decimal mark.

    A mark that occurs twice, or before another mark, groups; the last of two different marks is the decimal one; a lone
    point or comma is read as the site reads it, unless what it parts isn't grouped by threes.
    """
    s = re.sub(r"[   '’]", "", text)
    marks = [c for c in s if c in ".,"]
    if not marks:
        return _fraction(s)
    last = marks[-1]
    whole, _, tail = s.rpartition(last)
    if len(set(marks)) == 2 and marks.count(last) == 1:
        is_decimal = True
    elif len(marks) > 1:
        is_decimal = False
    else:
        is_decimal = last == decimal or len(tail) != 3 or not 1 <= len(whole) <= 3 or whole.startswith("0")
    digits = lambda x: x.replace(".", "").replace(",", "")
    return _fraction(digits(whole), tail) if is_decimal else _fraction(digits(s))


def _spelled(words: list[str]) -> Fraction | None:
    total, current, seen = 0, 0, False
    for w in words:
        if w == "and":
            continue
        if w in NUMBERS:
            current += NUMBERS[w]
        elif w in SCALES:
            current = max(1, current) * SCALES[w]
            if SCALES[w] >= 1000:
                total, current = total + current, 0
        else:
            return None
        seen = True
    return Fraction(total + current) if seen else None


_WORD = re.compile(r"[^\W\d_]+(?:/[^\W\d_]+)?\.?(?:\s?\((?i:metric)\))?", re.U)

# Units of several words.
_TWO_WORDS = re.compile(r"(?i:metric\s+(?:tonnes?|tons?)|(?:cubic|cu)\b\.?\s*(?:(?:centi|deci|milli)?(?:met(?:re|er)s?)|[cdm]?m|in(?:ch(?:es)?)?|f(?:oo|ee)?t)|fl(?:uid)?\b\.?\s*(?:oz|ounces?)|(?:us|imp(?:erial)?)\b\.?\s*gal(?:lons?)?|[cdm]?m\^?3(?!\d))(?![^\W\d_])")


@memo
def _lex(text: str, decimal: str, field: str) -> tuple[tuple[str, object], ...]:
    """Tokens: ('n', number), ('u', (dimension, size)), ('p', package), ('x', times), ('w', other word)."""
    out: list[tuple[str, object]] = []
    t = unicodedata.normalize("NFC", text).replace("μ", "µ")
    at = 0
    while at < len(t):
        c = t[at]
        if c in _VULGAR:
            out.append(("f", _VULGAR[c]))
            at += 1
        elif c.isdigit() and c.isascii():
            m = re.compile(r"(\d+)\s+(\d+)/(\d+)(?!\d)|(\d+)/(\d+)(?!\d)").match(t, at)
            if m and (d := int(m[3] or m[5])):
                out.append(("n", int(m[1] or 0) + Fraction(int(m[2] or m[4]), d)))
            else:
                m = _NUMBER.match(t, at)
                value = number(m[0], decimal)
                if e := re.compile(r"[eE]([+-]?\d{1,2})(?![\d])(?=\s|[A-Za-zµ]|$)").match(t, m.end()):
                    value *= Fraction(10) ** int(e[1])
                    m = e
                out.append(("n", value))
            at = m.end()
        elif c in "×*" or c in "xX" and re.compile(r"[xX](?=\s*\d)").match(t, at) and (at == 0 or not t[at - 1].isalpha()):
            out.append(("x", c))
            at += 1
        elif m := _WORD.match(t, at):
            word = m[0]
            two = _TWO_WORDS.match(t, at)
            if two:
                word, m = two[0], two
            if "/" in word and not segment(word, field):  # "kg/bag": what stands before the stroke, then the rest
                word = word.partition("/")[0]
                m = re.compile(re.escape(word)).match(t, at)
            low = word.lower().rstrip(".")
            if low in PACKAGES:
                out.append(("p", low))
            elif low in NUMBERS or low in SCALES:
                out.append(("v", low))
            elif unit := segment(word, field):
                out.append(("u", unit))
            else:
                out.append(("w", low))
            at = m.end()
        else:
            if not c.isspace():
                out.append(("s", c))
            at += 1
    # numbers in words, and fractions after whole numbers
    merged: list[tuple[str, object]] = []
    k = 0
    while k < len(out):
        kind, value = out[k]
        if kind == "v":
            end = k
            while end < len(out) and (out[end][0] == "v" or out[end] == ("w", "and") and end + 1 < len(out) and out[end + 1][0] == "v"):
                end += 1
            spelled = _spelled([v for _, v in out[k:end]])
            merged.append(("n", spelled) if spelled is not None else ("w", ""))
            k = end
            continue
        if kind == "f":
            if merged and merged[-1][0] == "n":
                merged[-1] = ("n", merged[-1][1] + value)
            else:
                merged.append(("n", value))
        else:
            merged.append((kind, value))
        k += 1
    return tuple(merged)


def unit_of(text: str | None, field: str = "quantity") -> tuple[str, Fraction, Fraction | None] | None:
    """(dimension, size, amount per piece or None) of a unit field, which may hold an amount; None if it says no measure."""
    return _unit_of(text, ".", field) if text else None


@memo
def _unit_of(text: str, decimal: str, field: str) -> tuple[str, Fraction, Fraction | None] | None:
    tokens = _lex(text, decimal, field)
    units = [v for kind, v in tokens if kind == "u"]
    numbers = [v for kind, v in tokens if kind == "n"]
    if len(units) != 1 or len(numbers) > 1:
        return None
    (dim, size), per = units[0], numbers[0] if numbers else None
    return (dim, size, per) if per is None or per > 0 else None


def says_nothing(text: str | None) -> bool:
    """Whether a unit field is null, blank or filled with signs only."""
    return text is None or not any(ch.isalnum() for ch in text)


def _whole(amount: Fraction) -> int | None:
    """Nearest whole number, halves up; None if it isn't positive or is beyond a BIGINT."""
    n = int(amount + Fraction(1, 2)) if amount > 0 else 0
    return n if 0 < n < 2**63 else None


@memo
def amount_of(text: str, decimal: str, field: str = "quantity") -> tuple[str, int] | None:
    """(dimension, total) of a sentence about an amount; None for counts of packages, references and blanks."""
    tokens = [t for t in _lex(text, decimal, field) if t[0] != "s" or t[1] == "="]
    kinds = "".join(k for k, _ in tokens)
    numbers = [(i, v) for i, (k, v) in enumerate(tokens) if k == "n"]
    units = [(i, v) for i, (k, v) in enumerate(tokens) if k == "u"]
    if not numbers or not units:
        return None
    if len({u[0] for _, u in units}) > 1:
        return None
    dim = units[0][1][0]
    # unit first: "kg 250"
    if len(units) == 1 and len(numbers) == 1:
        total = numbers[0][1] * units[0][1][1]
    elif len(units) == len(numbers) and all(kinds[i + 1 : i + 2] == "u" for i, _ in numbers) and "x" not in kinds and "p" not in kinds:
        total = sum(v * units[k][1][1] for k, (_, v) in enumerate(numbers))  # "2 kg 310 g"
    elif len(units) == 1 and len(numbers) == 2:  # "5 x 2 kg", "5 DRUMS OF 2 kg", "2 kg * 5 bags", "5 boxes, each 2 kg"
        total = numbers[0][1] * numbers[1][1] * units[0][1][1]
    elif len(units) == 1 and len(numbers) == 3 and kinds.count("x") == 2:
        total = numbers[0][1] * numbers[1][1] * numbers[2][1] * units[0][1][1]
    else:
        return None
    n = _whole(total)
    return None if n is None else (dim, n)


# The phrases that name the unit of the quantity inside a description.
_DESCRIBED = re.compile(r"(?:quantity\s+in|quantities\s*(?:in|:)|qty\.?\s+(?:stated\s+)?in|qty\.?\s*:|unit\s+of\s+(?:order|measure)\s*:|unit\s*:|uom\s*:)\s*([^\W\d_][^,;]*?)\s*(?=[,;]|\)\s*$|$)", re.I)


@memo
def described_unit(description: str, field: str = "quantity") -> tuple[str, Fraction] | None:
    """The unit that a description gives for the quantity, None if it gives none."""
    found = _DESCRIBED.findall(re.sub(r"\s+", " ", description))
    for text in found:
        if unit := segment(text, field):
            return unit
    return None


def order_amount(quantity: float | None, unit: str | None, description: str | None, decimal: str) -> tuple[str, int] | None:
    """(dimension, total) of an ordered quantity in its unit, or in the unit that the description gives for it."""
    if quantity is None or quantity != quantity or quantity <= 0 or quantity == float("inf"):
        return None
    exact = Fraction(repr(float(quantity)))
    if says_nothing(unit):
        found = described_unit(description) if description else None
        per = None
    else:
        found = _unit_of(unit, decimal, "quantity")
        found, per = (None, None) if found is None else (found[:2], found[2])
    if found is None:
        return None
    n = _whole(exact * (per or 1) * found[1])
    return None if n is None else (found[0], n)


def item_amount(value: float | None, unit: str | None, text: str | None, decimal: str) -> tuple[str, int] | None:
    """(dimension, total) of an item's value in its unit or, where these state no measure, of its text."""
    return order_amount(value, unit, None, decimal) or (amount_of(text, decimal) if text else None)


def normalise_quantities(df: DataFrame) -> DataFrame:
    """Add ``dim`` and ``amount`` (whole micrograms or microlitres) to rows that state a quantity.

    Reads ``field`` ('quantity' reads value and unit, then text and description; any other field reads ``text`` only),
    ``value``, ``unit``, ``text``, ``description`` and ``decimal_mark``; other columns pass through, existing columns
    named ``dim`` or ``amount`` are replaced.

    Nulls in any column, empty or blank texts, zero, negative, infinite and not-a-number values, mere package counts and
    references and totals beyond a BIGINT give null in both; texts are read whole, however long. A null decimal mark counts
    as a point. Halves of a unit round up. Equal rows give equal results; no row is dropped.
    """

    @F.pandas_udf("struct<dim string, amount bigint>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        none = lambda s: s.astype(object).where(s.notna(), None)
        for field, value, unit, text, description, decimal in batches:
            rows = []
            for f, v, u, t, d, m in zip(*(none(s) for s in (field, value, unit, text, description, decimal)), strict=True):
                m = m or "."
                if f == "quantity":
                    got = order_amount(v, u, d, m) or (amount_of(t, m) if t else None)
                else:
                    got = amount_of(t, m, "weight") if t else None
                rows.append(got or (None, None))
            out = pd.DataFrame(rows, columns=["dim", "amount"])
            yield out.assign(amount=out["amount"].astype("Int64"))

    found = df.withColumn("_found", run("field", F.col("value").cast("double"), "unit", "text", "description", "decimal_mark"))
    return found.withColumn("dim", F.col("_found.dim")).withColumn("amount", F.col("_found.amount")).drop("_found")
