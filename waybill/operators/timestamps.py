"""Dates and times printed in many ways, brought into one unambiguous form.

1. Each text is tokenised into a *shape mask*: runs of digits become ``9`` times their length, words become a letter for
   what they can be (month ``M``, weekday ``W``, zone ``Z``, half of day ``P``, filler ``F``), punctuation stays.
2. Each distinct mask is mapped to a *parser* once per worker (:func:`parser_for`): the list of which token holds which
   field. A batch holds thousands of texts but few masks, so no text is ever tried against a list of formats.
3. All texts of a mask are converted together, vectorised over numpy arrays: fields to day numbers, local times to UTC
   through zone transition tables (:func:`transitions`), which carry the version of the zone database they came from.

The operator is one narrow Arrow-batched stage: no shuffle, no lookup join, memory bounded by the batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, ZoneInfoNotFoundError

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Month names and abbreviations by language, January first.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "tr": "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}
# Further abbreviations that aren't the first three letters of a name above.
MONTHS_MORE = {"sept": 9, "okt": 10, "mrz": 3, "janv": 1, "févr": 2, "avr": 4, "juil": 7, "déc": 12, "ene": 1, "abr": 4, "ago": 8, "dic": 12, "fev": 2, "set": 9, "out": 10, "dez": 12, "gen": 1, "mag": 5, "giu": 6, "lug": 7, "ott": 10, "mrt": 3, "mei": 5}
# Zone abbreviations and their offsets in minutes, where the zone in question uses them; "" holds anywhere.
ABBREVIATIONS = {
    "": {"utc": 0, "z": 0, "gmt": 0},
    "Europe/": {"wet": 0, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180},
    "Europe/London": {"bst": 60},
    "Europe/Dublin": {"ist": 60},
    "Europe/Moscow": {"msk": 180},
    "America/": {"est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "ast": -240, "adt": -180},
    "America/Sao_Paulo": {"brt": -180, "brst": -120},
    "America/Argentina/Buenos_Aires": {"art": -180},
    "Asia/Kolkata": {"ist": 330},
    "Asia/Jerusalem": {"ist": 120, "idt": 180},
    "Asia/Shanghai": {"cst": 480},
    "Asia/Taipei": {"cst": 480},
    "Asia/Dubai": {"gst": 240},
    "Asia/Tokyo": {"jst": 540},
    "Asia/Seoul": {"kst": 540},
    "Asia/Singapore": {"sgt": 480},
    "Asia/Hong_Kong": {"hkt": 480},
    "Australia/": {"aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480},
}
# Words around a date that say nothing about it.
FILLERS = frozenset("date dated dt at on of de del the orig original um le el den uhr hrs h st nd rd th er º ª local time o clock à a às a las alle ore kl saat в".split())
HALVES = {"am": 0, "pm": 12}
#: A half of the day written with stops or blanks.
_HALF = re.compile(r"(?<![^\W_])([AaPp])\.\s?([Mm])(?![^\W_])\.?")
#: No printed date and time holds more numbers; masks longer than MEMO signs aren't kept.
MOST_NUMBERS = 12
MEMO = 256

_TOKEN = re.compile(r"\d+|[^\W\d_]+(?:[/_+-](?=[A-Z])[^\W\d_]+)*|年|月|日|\s+|.", re.S)
_EPOCH = datetime(1970, 1, 1)
#: Day 0 of spreadsheets, in days of Unix time; shorter numbers than SHEET_FROM are days of Unix time.
SHEET_DAY_0 = -25_569
SHEET_FROM = 30_000
#: Zone rules are tabulated from this year to that.
ZONE_YEARS = (1900, 2200)


@lru_cache(1)
def month_names() -> dict[str, int]:
    names = dict(MONTHS_MORE)
    for line in MONTHS.values():
        for k, name in enumerate(line.split(), 1):
            for form in (name, name[:3] if len(name) > 3 else name):
                names.setdefault(form, k)
    return names | {_bare(n): k for n, k in names.items()}


@lru_cache(1)
def weekday_names() -> frozenset[str]:
    # Weekday names.
    full = "monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo segunda terça quarta quinta sexta".split()
    return frozenset(full) | {n[:3] for n in full[:7]} | {"tues", "thur", "thurs"}


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@lru_cache(1)
def zone_version() -> str:
    """Version of the zone database behind :func:`transitions`: the system's, else the package's."""
    for folder in TZPATH:
        table = Path(folder, "tzdata.zi")
        if table.exists():
            with table.open() as lines:
                return lines.readline().removeprefix("# version").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


@lru_cache(4096)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(UTC seconds of each change, local seconds from which it holds, offsets in seconds before, between and after).

    A local time that occurs twice means the earlier instant and one that is skipped is read with the offset before the
    change: both mean that a change holds from its UTC second plus the larger of the offsets around it.
    """
    try:
        info = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None
    offset = lambda s: int((_EPOCH + timedelta(seconds=s)).replace(tzinfo=timezone.utc).astimezone(info).utcoffset().total_seconds())
    low, high = (int((datetime(y, 1, 1) - _EPOCH).total_seconds()) for y in ZONE_YEARS)
    step = 20 * 86_400
    at, offsets = [], [offset(low)]
    for s in range(low, high, step):
        before, after = offsets[-1], offset(s + step)
        if before != after:
            a, b = s, s + step
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset(mid) == before else (a, mid)
            at.append(b)
            offsets.append(after)
    changes, values = np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)
    return changes, changes + np.maximum(values[:-1], values[1:]), values


def to_utc(local: np.ndarray, zone: str) -> np.ndarray:
    """Local seconds in a zone to UTC seconds."""
    table = transitions(zone)
    if table is None:
        raise ValueError(f"unknown zone {zone}")
    return local - table[2][np.searchsorted(table[1], local, side="right")]


def abbreviation_offset(word: str, zone: str | None) -> int | None:
    """Offset in seconds that a zone abbreviation means at a site in ``zone``."""
    word = word.lower()
    best, length = None, -1
    for prefix, names in ABBREVIATIONS.items():
        if word in names and (prefix == "" or (zone or "").startswith(prefix)) and len(prefix) > length:
            best, length = names[word], len(prefix)
    if best is None:  # an abbreviation that the site doesn't use: its usual meaning, if it has only one
        every = {names[word] for names in ABBREVIATIONS.values() if word in names}
        best = every.pop() if len(every) == 1 else None
    return None if best is None else best * 60


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(_HALF.sub(r"\1\2", text))


def _word_class(word: str) -> str:
    low = word.lower()
    if low in ("年", "月", "日"):
        return low
    if low in ("t", "w", "h"):
        return low.upper() if low != "h" else "h"
    if low in month_names() or _bare(low) in month_names():
        return "M"
    if low in HALVES:
        return "P"
    if low in weekday_names():
        return "D"
    if any(low in names for names in ABBREVIATIONS.values()):
        return "Z"
    if "/" in word and word[0].isupper():
        return "I"
    return "F" if low in FILLERS else "X"


def mask_of(tokens: list[str]) -> str:
    """The shape mask: one sign per token, digits repeated by length; blanks are one space."""
    out = []
    for t in tokens:
        if t[0].isdigit() and t.isascii():
            out.append("9" * len(t))
        elif t.isspace():
            out.append(" ")
        elif t[0].isalpha():
            out.append(_word_class(t))
        else:
            out.append(t)
    return "".join(out)


class Parser:
    """Which token of a mask holds which field; ``numeric`` lists the three tokens of an all-numeric date."""

    def __init__(self, kind: str, fields: dict[str, int], numeric: tuple[int, ...] = (), zone: str = "", sign: int = 1):
        self.kind, self.fields, self.numeric, self.zone, self.sign = kind, fields, numeric, zone, sign


def parser_for(mask: str, count: int) -> Parser | None:
    """The parser of a mask of ``count`` tokens, None if such a text is no date. Worked out once per distinct mask."""
    return _parser_for(mask, count) if len(mask) <= MEMO else _parser_for.__wrapped__(mask, count)


@lru_cache(65_536)
def _parser_for(mask: str, count: int) -> Parser | None:
    signs = []  # (sign, token index)
    k, at = 0, 0
    while at < len(mask):
        if mask[at] == "9":
            end = at
            while end < len(mask) and mask[end] == "9":
                end += 1
            signs.append(("9" * (end - at), k))
            at = end
        else:
            signs.append((mask[at], k))
            at += 1
        k += 1
    if k != count:
        return None  # two runs of digits without anything between can't happen
    body = "".join(s[0] if s[0] != "9" else f"<{len(s)}>" for s, _ in signs)
    index = [i for _, i in signs]
    # token positions within ``body`` by regular expression over signs: give each sign one character
    chars = "".join("9" if s[0] == "9" else s for s, _ in signs)
    length = {j: len(s) for j, (s, _) in enumerate(signs) if s[0] == "9"}
    del body

    # what stands before and after: fillers, blanks, brackets and stops
    lead = re.match(r"(?:[F .,:;(\[]|X(?=[ .]*:))*", chars).end()
    stop = len(chars) - re.match(r"(?:[ .;,*]|\)\W*(?:F|X)\W*\()*", chars[::-1]).end()
    core = chars[lead:stop]
    ix = lambda j: index[lead + j]
    size = lambda j: length[lead + j]
    if not core or "9" not in core or "X" in core or core.count("9") > MOST_NUMBERS:
        return None

    # a number alone
    if core == "9":
        n = size(0)
        kind = {5: "days", 8: "ymd8", 10: "s", 12: "ymd12", 13: "ms", 14: "ymd14", 16: "us", 19: "ns"}.get(n)
        return Parser(kind, {"n": ix(0)}) if kind else None

    fields: dict[str, int] = {}
    zone, sign = "", 1
    rest = core

    def take(pattern: str, names: dict[int, str], where: str = "end") -> re.Match | None:
        nonlocal rest
        m = re.search(pattern, rest)
        if m:
            for group, name in names.items():
                if m[group] is not None:
                    fields[name] = m.start(group)
        return m

    base = 0  # rest is core[base:base+len(rest)]
    # zones at the end
    if m := re.search(r"\[I\]$", rest):
        rest = rest[: m.start()]
    if m := re.search(r" ?(I)$", rest):
        fields["zone"], zone, rest = m.start(1), "name", rest[: m.start()]
    elif m := re.search(r" ?\(?(Z)\)?$", rest):
        fields["zone"], zone, rest = m.start(1), "word", rest[: m.start()]
    elif (m := re.search(r" ?Z?([+\-−])(9):?(9)?$", rest)) and re.search(r"(?:9:9|T9)(?:[:.,]9)*(?: ?P)?$", rest[: m.start()]):
        fields["off_h"], zone = m.start(2), "offset"
        if m[3]:
            fields["off_m"] = m.start(3)
        sign = 1 if m[1] == "+" else -1
        rest = rest[: m.start()]

    # the time of day
    time_part = r"(9):(9)(?::(9)(?:[.,](9))?)?(?: ?(P)| ?F)?"
    if m := re.search(rf"^{time_part}(?:[ ,]+F?[ ]*)(?=.)", rest):  # in front
        span = (0, m.end())
    elif m := re.search(rf"(?:(?<=[9M日])(?:T|,? ?(?:F )?|[ ,T]+)){time_part}$|(?:T|,? (?:F )?){time_part}$", rest):
        span = m.span()
    elif m := re.search(r"(?: |, )(9)(h)(9)?$", rest):
        span = m.span()
        fields["H"] = m.start(1)
        if m[3]:
            fields["mi"] = m.start(3)
        m = None
    else:
        span = None
    if span and "H" not in fields and m:
        groups = [g for g in range(1, (m.re.groups or 0) + 1) if m[g] is not None]
        nines = [m.start(g) for g in groups if m[g] == "9"]
        for name, p in zip(("H", "mi", "s"), nines, strict=False):
            fields[name] = p
        for g in groups:
            if m[g] == "P":
                fields["half"] = m.start(g)
    if span is None and (m := re.search(r"T(9)$", rest)) and size(m.start(1)) in (4, 6):  # compact
        fields["hms"], span = m.start(1), m.span()
    if span:
        if span[0] == 0:
            base, rest = span[1], rest[span[1] :]
        else:
            rest = rest[: span[0]]
    at_ = lambda j: ix(base + j)
    n_ = lambda j: size(base + j)
    done = {k: ix(v) for k, v in fields.items()}
    timed = bool(span)
    if zone and not timed:
        return None
    lead_in = re.match(r"(?:D[ .,]*|F[ .]*|[ ,])*", rest).end()
    base, rest = base + lead_in, re.sub(r"[ ,.]+$", "", rest[lead_in:])

    def made(kind: str, **where: int) -> Parser:
        return Parser(kind, done | {k: at_(v) for k, v in where.items()}, zone=zone, sign=sign)

    if rest == "9":
        if n_(0) == 8:
            return made("ymd8t" if timed else "ymd8", n=0)
        return None
    if re.fullmatch(r"9年9月9日", rest):
        return made("named", y=0, mo_n=2, d=4)
    if re.fullmatch(r"9年9月", rest) and not timed:
        return made("named", y=0, mo_n=2)
    if m := re.fullmatch(r"(9)(?:F)?(?:[ .,\-/']|F)*(M)[ .,\-/']*(?:F)?[ ]*(9)", rest):
        if n_(0) == 4 and n_(m.start(3)) <= 2:
            return made("named", y=0, mo=m.start(2), d=m.start(3))
        return made("named", d=0, mo=m.start(2), y=m.start(3)) if n_(0) <= 2 and n_(m.start(3)) in (2, 4) else None
    if m := re.fullmatch(r"(M)[ .\-/]*(9)F?[ .,\-/]+(9)", rest):
        return made("named", mo=0, d=m.start(2), y=m.start(3)) if n_(m.start(2)) <= 2 and n_(m.start(3)) in (2, 4) else None
    if (m := re.fullmatch(r"(M)[ .,\-/'’]*(?:F )?(9)", rest)) and not timed:
        return made("named", mo=0, y=m.start(2)) if n_(m.start(2)) in (2, 4) else None
    if (m := re.fullmatch(r"(9)[ \-/.]?(M)", rest)) and not timed and n_(0) == 4:
        return made("named", y=0, mo=m.start(2))
    if re.fullmatch(r"9[\-/.]9", rest) and not timed:
        if n_(0) == 4 and n_(2) == 3:
            return made("ordinal", y=0, n=2)
        if n_(0) == 4 and n_(2) <= 2:
            return made("named", y=0, mo_n=2)
        return made("named", mo_n=0, y=2) if n_(0) <= 2 and n_(2) == 4 else None
    if (m := re.fullmatch(r"(9)-?W(9)(?:-?(9))?", rest)) and n_(0) == 4 and not timed:
        return made("week", y=0, n=m.start(2), **({"d": m.start(3)} if m[3] else {})) if m[3] else None
    if m := re.fullmatch(r"(9)(?: ?([\-/.]) ?)(9)\.?(?: ?[\-/.] ?)(9)", rest):
        a, b, c = (m.start(g) for g in (1, 3, 4))
        sizes = n_(a), n_(b), n_(c)
        if sizes[0] == 4 and sizes[1] == 3:
            return None
        if max(sizes[0], sizes[1]) <= 2 and sizes[2] in (2, 4) or sizes[0] == 4 and sizes[1] <= 2 and sizes[2] <= 2:
            return Parser("year_first" if sizes[0] == 4 else "numeric", done, tuple(at_(j) for j in (a, b, c)), zone, sign)
    return None


def _days(y: np.ndarray, mo: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(day numbers of Unix time, whether such a day exists)."""
    good = (mo >= 1) & (mo <= 12) & (d >= 1) & (y >= 1) & (y <= 9999)
    month = (np.where(good, y, 1970).astype("int64") - 1970) * 12 + np.where(good, mo, 1) - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    nxt = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + np.where(good, d, 1) - 1, good & (d <= nxt - first)


def _int(tokens: list[list[str]], k: int) -> np.ndarray:
    return np.array([t[k] for t in tokens]).astype(np.int64)


_ORDERS = {"DMY": ((2, 1, 0), (2, 0, 1)), "MDY": ((2, 0, 1), (2, 1, 0)), "YMD": ((0, 1, 2), (2, 1, 0), (2, 0, 1))}


def _convert(parser: Parser, tokens: list[list[str]], zones: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, ...]:
    """(seconds of Unix time or day numbers or months, precision 's', 'd', 'm' or '' where there is no such date)."""
    n = len(tokens)
    f = parser.fields
    precision = np.full(n, "d", dtype="U1")
    good = np.ones(n, dtype=bool)
    if parser.kind in ("s", "ms", "us", "ns"):
        value = _int(tokens, f["n"]) // {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}[parser.kind]
        return value, np.full(n, "s", dtype="U1")
    if parser.kind == "days":
        v = _int(tokens, f["n"])
        return np.where(v >= SHEET_FROM, v + SHEET_DAY_0, v), precision
    text = [t[f["n"]] for t in tokens] if "n" in f else []
    part = lambda a, b: np.array([x[a:b] for x in text]).astype(np.int64)
    timed, seconds = False, np.zeros(n, dtype=np.int64)
    month_only = False
    if parser.kind in ("ymd8", "ymd8t", "ymd12", "ymd14"):
        days, good = _days(part(0, 4), part(4, 6), part(6, 8))
        if parser.kind == "ymd8":
            # eight digits that don't spell year, month, day may spell them in the site's order
            for order, at in (("DMY", ((4, 8), (2, 4), (0, 2))), ("MDY", ((4, 8), (0, 2), (2, 4)))):
                other, fine = _days(*(part(a, b) for a, b in at))
                use = ~good & fine & (orders == order)
                days, good = np.where(use, other, days), good | use
        if parser.kind in ("ymd12", "ymd14"):
            timed = True
            h, mi = part(8, 10), part(10, 12)
            s = part(12, 14) if parser.kind == "ymd14" else np.zeros(n, dtype=np.int64)
            good &= (h < 24) & (mi < 60) & (s < 60)
            seconds = h * 3600 + mi * 60 + s
    elif parser.kind == "ordinal":
        y, k = _int(tokens, f["y"]), _int(tokens, f["n"])
        days, good = _days(y, np.full(n, 1), np.full(n, 1))
        days = days + k - 1
        good = good & (k >= 1) & (k <= 365 + _days(y, np.full(n, 2), np.full(n, 29))[1])
    elif parser.kind == "week":
        y, w, d = _int(tokens, f["y"]), _int(tokens, f["n"]), _int(tokens, f["d"])
        fourth, good = _days(y, np.full(n, 1), np.full(n, 4))
        days = fourth - (fourth + 3) % 7 + (w - 1) * 7 + d - 1
        good = good & (w >= 1) & (w <= 53) & (d >= 1) & (d <= 7)
    elif parser.kind == "named":
        y = _int(tokens, f["y"])
        y = np.where(np.array([len(t[f["y"]]) for t in tokens]) <= 2, y + 2000, y)
        if "mo" in f:
            names = month_names()
            mo = np.array([names.get(t[f["mo"]].lower()) or names[_bare(t[f["mo"]].lower())] for t in tokens], dtype=np.int64)
        else:
            mo = _int(tokens, f["mo_n"])
        if "d" in f:
            days, good = _days(y, mo, _int(tokens, f["d"]))
        else:
            month_only = True
            days, good = _days(y, mo, np.ones(n, dtype=np.int64))
    else:  # three numbers
        a = [_int(tokens, k) for k in parser.numeric]
        short = len(tokens[0][parser.numeric[2]]) <= 2 and parser.kind == "numeric"
        if short:
            a[2] = a[2] + 2000
        days, good = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        tries = {None: ((0, 1, 2), (0, 2, 1))} if parser.kind == "year_first" else {o: (v[1:] if o == "YMD" else v) for o, v in _ORDERS.items()}
        for order, ways in tries.items():
            here = np.ones(n, dtype=bool) if order is None else orders == order
            for way in ways:
                d, fine = _days(*(a[k] for k in way))
                use = here & ~good & fine
                days, good = np.where(use, d, days), good | use
        if parser.kind == "numeric":  # a site whose order is unknown counts as day first
            for way in _ORDERS["DMY"]:
                d, fine = _days(*(a[k] for k in way))
                use = ~np.isin(orders, list(_ORDERS)) & ~good & fine
                days, good = np.where(use, d, days), good | use
    if "hms" in f:
        timed = True
        x = [t[f["hms"]].ljust(6, "0") for t in tokens]
        h, mi, s = (np.array([v[k : k + 2] for v in x]).astype(np.int64) for k in (0, 2, 4))
        good &= (h < 24) & (mi < 60) & (s < 60)
        seconds = h * 3600 + mi * 60 + s
    elif "H" in f:
        timed = True
        h = _int(tokens, f["H"])
        mi = _int(tokens, f["mi"]) if "mi" in f else np.zeros(n, dtype=np.int64)
        s = _int(tokens, f["s"]) if "s" in f else np.zeros(n, dtype=np.int64)
        if "half" in f:
            half = np.array([HALVES[t[f["half"]].lower()] for t in tokens], dtype=np.int64)
            good &= (h >= 1) & (h <= 12)
            h = h % 12 + half
        good &= ((h < 24) | (h == 24) & (mi == 0) & (s == 0)) & (mi < 60) & (s < 60)
        seconds = h * 3600 + mi * 60 + s
    if not timed:
        precision[:] = "m" if month_only else "d"
        return days, np.where(good, precision, "")
    local = days * 86_400 + seconds
    if parser.zone == "offset":
        h = [t[f["off_h"]] for t in tokens]
        hours = np.array([int(x[:2]) if len(x) > 2 else int(x) for x in h], dtype=np.int64)
        minutes = np.array([int(x[2:] or 0) if len(x) > 2 else 0 for x in h], dtype=np.int64)
        if "off_m" in f:
            minutes = _int(tokens, f["off_m"])
        good &= (hours <= 18) & (minutes < 60)
        local = local - parser.sign * (hours * 3600 + minutes * 60)
    elif parser.zone == "word":
        pairs = [(t[f["zone"]].lower(), z) for t, z in zip(tokens, zones, strict=True)]
        known = {p: abbreviation_offset(*p) for p in set(pairs)}
        good &= np.array([known[p] is not None for p in pairs])
        local = local - np.array([known[p] or 0 for p in pairs], dtype=np.int64)
    else:
        where = np.array([t[f["zone"]] for t in tokens]) if parser.zone == "name" else zones
        for zone in set(where.tolist()):
            here = where == zone
            if zone is None or transitions(zone) is None:
                good &= ~here
            else:
                local[here] = to_utc(local[here], zone)
    return local, np.where(good, "s", "").astype("U1")


def normalise(texts: list[str | None], zones: list[str | None], orders: list[str | None]) -> list[str | None]:
    """Each text's one form: ``YYYY-MM-DDTHH:MM:SSZ`` in UTC, ``YYYY-MM-DD`` or ``YYYY-MM``; None if it is no date."""
    out: list[str | None] = [None] * len(texts)
    groups: dict[tuple[str, int], list[tuple[int, list[str]]]] = {}
    for i, text in enumerate(texts):
        if text and (text := text.strip()):
            tokens = tokens_of(unicodedata.normalize("NFKC", text))
            groups.setdefault((mask_of(tokens), len(tokens)), []).append((i, tokens))
    zone_array, order_array = np.array(zones, dtype=object), np.array([o or "" for o in orders])
    for key, members in groups.items():
        parser = parser_for(*key)
        if parser is None:
            continue
        at = np.array([i for i, _ in members])
        value, precision = _convert(parser, [t for _, t in members], zone_array[at], order_array[at])
        for p, unit, tail in (("s", "s", "Z"), ("d", "D", ""), ("m", "D", "")):
            here = precision == p
            if here.any():
                printed = np.datetime_as_string(value[here].astype(f"datetime64[{unit}]"))
                for i, s in zip(at[here], printed, strict=True):
                    out[i] = s[:7] if p == "m" else s + tail
    return out


def zone_tables(spark: SparkSession, zones: list[str]) -> DataFrame:
    """(zone, version, at, offset): the tables behind the conversion, a row for each change of each known zone.

    ``at`` is the UTC second of the change, null for the offset before the first; ``version`` is that of the database.
    """
    rows = [(z, zone_version(), *x) for z in sorted(set(zones)) if (t := transitions(z)) for x in zip([None, *t[0].tolist()], t[2].tolist(), strict=True)]
    return spark.createDataFrame(rows, "zone string, version string, at long, offset long")


def normalise_timestamps(df: DataFrame, text: str, zone: str, order: str, into: str = "norm", version: str | None = None) -> DataFrame:
    """Add ``into``, the unambiguous form of the column ``text``; see :func:`normalise`.

    ``zone`` names the column with the site's zone, ``order`` that with its usual order of all-numeric dates, ``version``
    a column to add with the version of the zone tables (none if not asked for).
    Nulls, empty and blank texts and what denotes no real date, however long, give null. A local time
    that occurs twice means the earlier instant; a skipped one is read with the offset before the change. A null or
    unknown zone makes local times null, but not dates; a null order counts as day first. Ties don't arise: equal rows
    give equal results, none is dropped. An existing column ``into`` is replaced, others pass through.
    """

    @F.pandas_udf(StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, z, o in batches:
            none = lambda s: s.astype(object).where(s.notna(), None).tolist()
            yield pd.Series(normalise(none(t), none(z), none(o)), dtype=object)

    out = df.withColumn(into, run(F.col(text).cast("string"), F.col(zone).cast("string"), F.col(order).cast("string")))
    return out.withColumn(version, F.lit(zone_version())) if version else out
