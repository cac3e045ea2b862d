"""Column functions on numbers: words, money, general format, parsing, cell references. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
ONES = "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN".split()
TENS = ["", "", *"TWENTY THIRTY FORTY FIFTY SIXTY SEVENTY EIGHTY NINETY".split()]
#: Beyond this an amount has no words.
LARGEST = 2 * 10**12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number_words(n: Column) -> Column:
    """Words of a whole number from 0 to 1999 (the count of a scale), null for 0."""
    ones, tens = F.array(*[F.lit(w) for w in ONES]), F.array(*[F.lit(w) for w in TENS])
    hundreds, rest = (n / 100).cast("int"), (n % 100).cast("int")
    small = F.when(rest >= 20, F.concat_ws(" ", F.get(tens, (rest / 10).cast("int")), F.when(rest % 10 > 0, F.get(ones, (rest % 10).cast("int"))))).when(rest > 0, F.get(ones, rest))
    return F.nullif(F.concat_ws(" ", F.when(hundreds > 0, F.concat(F.get(ones, hundreds), F.lit(" HUNDRED"))), small), F.lit(""))


def whole_words(n: Column | str) -> Column:
    """A whole number in words; null at or beyond ``LARGEST``."""
    v = F.abs(_c(n))
    parts = [F.concat(number_words(((v / s).cast("long")) % (1000 if s < 10**9 else 10_000)), F.lit(f" {name}")) for s, name in ((10**9, "BILLION"), (10**6, "MILLION"), (1000, "THOUSAND"))]
    said = F.concat_ws(" ", *parts, number_words(v % 1000))
    return F.when(v >= LARGEST, None).when(v == 0, "ZERO").otherwise(F.concat(F.when(_c(n) < 0, "MINUS ").otherwise(""), said))


def amount_words(amount: Column | str, currency: Column | str) -> Column:
    """An amount, rounded half to even, in words with its currency."""
    return F.concat(whole_words(F.bround(_c(amount)).cast("decimal(20,0)")), F.lit(" "), _c(currency), F.lit(" ONLY."))


def money(x: Column | str) -> Column:
    """Thousands separated, two decimals, none if there is no fraction."""
    v = _c(x).cast("double")
    printed = F.format_number(v, 2)
    return F.when(v == F.floor(v), F.regexp_replace(printed, r"\.00$", "")).otherwise(printed)


def general(x: Column | str) -> Column:
    """Six significant digits without trailing zeros; scientific from 1e6 and below 1e-4."""
    v = _c(x).cast("double")
    size = F.abs(v)
    e = F.when(size == 0, 0).otherwise(F.floor(F.log10(size)).cast("int"))
    # format_number rounds the binary value itself, half to even, as people's tools do
    plain = F.element_at(F.array(*[F.replace(F.format_number(v, d), F.lit(","), F.lit("")) for d in range(10)]), F.greatest(F.lit(1), F.least(F.lit(10), 6 - e)))
    trimmed = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    science = F.regexp_replace(F.format_string("%.5e", v), r"\.?0*e", "e")
    return F.when((size != 0) & ((F.abs(plain.cast("double")) >= 1e6) | (e < -4)), science).otherwise(trimmed)


def cleaned_number(x: Column | str) -> Column:
    """Digits, point and minus of a text as a number, 0 if they don't make one."""
    return F.coalesce(F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), r"[^0-9.\-]", "").try_cast("double"), F.lit(0.0))


def column_number(letters: Column | str) -> Column:
    """Column letters as a number, A = 1."""
    return F.aggregate(F.split(F.upper(_c(letters)), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def cell_row(ref: Column | str) -> Column:
    return F.regexp_extract(F.replace(_c(ref), F.lit("$"), F.lit("")), r"^([A-Za-z]+)(\d+)$", 2).try_cast("int")


def cell_column(ref: Column | str) -> Column:
    return column_number(F.regexp_extract(F.replace(_c(ref), F.lit("$"), F.lit("")), r"^([A-Za-z]+)(\d+)$", 1))
