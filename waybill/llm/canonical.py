"""Freely typed values to the entries of a reference list, with those reported that denote none.

A symmetric-delete dictionary holds every spelling of an entry (its own, its usual other names, its words cut short)
with up to two characters deleted. A value's own deletions meet those of each spelling within two edits, so a lookup
costs a few dictionary hits and never scans the list. What meets is ranked by a weighted Damerau-Levenshtein distance
(look-alike characters are cheap), then by how often the entry occurs in the data, then by its id.

The dictionary is broadcast behind a check of its size, which is worked out from the spellings' lengths before it is
built; each worker memoises values, so a value that fills a third of the rows is looked up once. No shuffle. A list whose
dictionary would pass the bound stays a table and goes through an equi-join on deletions instead (:func:`map_by_join`),
with the same results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.session import BROADCAST_LIMIT

MAX_DELETES = 2
#: Memos hold no longer values.
MEMO = 256
#: Forms of one value that are taken one by one; after so many comes the one without any decoration.
MANY_FORMS = 64
# Characters that scanners and hands confuse.
LOOK_ALIKE = [("0", "o"), ("1", "l"), ("1", "i"), ("l", "i"), ("5", "s"), ("6", "b"), ("9", "g"), ("8", "b"), ("c", "e"), ("2", "z"), ("u", "v"), ("q", "g")]
_CHEAP = {frozenset(p) for p in LOOK_ALIKE}


def plain(text: str) -> str:
    """Lower case without accents, typographic variants folded."""
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in text if not unicodedata.combining(c)).replace("ß", "ss").replace("ı", "i").replace("ø", "o")


def key_of(text: str) -> str:
    """What is compared: letters and digits only, with 'Date, Expiry' turned into 'Expiry Date'."""
    text = plain(text)
    head, comma, tail = text.partition(",")
    if comma and head.strip() and re.search(r"\w", tail):
        text = f"{tail} {head}"
    return re.sub(r"[\W_]+", "", text)


_TRIMS = [
    re.compile(r"^\s*(?:\d+(?:\.\d+)*\s*[.)]?|[ivx]+[.)]|[-*•])\s+(?=\S)", re.I),
    re.compile(r"^\s*\d+(?:\.\d+)*[.)]\s*(?=\S)"),
    re.compile(r"\s*[(\[][^()\[\]]*[)\]]\s*\W*$"),
    re.compile(r"\s+by\s+titration\W*$", re.I),
    re.compile(r"\s+-\s*\S+\s+method\W*$", re.I),
    re.compile(r"\s+test\W*$", re.I),
    re.compile(r"(?<=\w)\s*[%*:.\-–]+\s*$"),
]
_ORIGIN_TRIMS = [
    re.compile(r"^\s*(?:made|mfd\.?|manufactured|produced)\s+in\s+", re.I),
    re.compile(r"^\s*produce\s+of\s+", re.I),
    re.compile(r"^\s*(?:country(?:\s+of\s+origin)?|origin)\s*[:\-]\s*", re.I),
    re.compile(r"\s+origin\W*$", re.I),
    re.compile(r"^\s*\((?=[^)]*\)\s*$)|(?<=\w)\.?\)\s*$"),
    re.compile(r"(?<=\w)\s*[*:.\-–]+\s*$"),
]


def trimmed(value: str, kind: str) -> list[str]:
    """The value, then without the decorations around it (numbering, brackets, method, marks), one by one; distinct.

    Of a value with very many decorations, the steps that take one of them are followed by the value without any.
    """
    trims = _ORIGIN_TRIMS if kind == "country" else _TRIMS
    out, queue = {}, deque([re.sub(r"\s+", " ", value)])
    while queue:
        x = queue.popleft()
        if x in out:
            continue
        out[x] = None
        if len(out) >= MANY_FORMS:
            bare, last = x, None
            while bare != last:
                last = bare
                for t in trims:
                    bare = y if (y := t.sub("", bare)).strip() else bare
            return list(out | {bare: None})
        queue.extend(y for t in trims if (y := t.sub("", x)) != x and y.strip())
    return list(out)


def keys_of(value: str, kind: str) -> list[str]:
    """What of a value is compared, the whole first, then without decorations; distinct."""
    return list(dict.fromkeys(k for x in trimmed(value, kind) if (k := key_of(x))))


def truncated(text: str, least: int = 6, kept: int = 4) -> str:
    """Each longer word cut to its first characters, as people abbreviate column heads."""
    return " ".join(w[:kept] if len(w) >= least else w for w in text.split())


def deletions(key: str, depth: int) -> set[str]:
    out = {key}
    for d in range(1, min(depth, len(key) - 1) + 1):
        for at in combinations(range(len(key)), d):
            out.add("".join(c for i, c in enumerate(key) if i not in at))
    return out


#: Kinds whose short names are codes: with a letter changed such a name is another code.
CODED = frozenset(["country"])


def depth_of(key: str, kind: str = "") -> int:
    """Edits looked for, by length."""
    return 0 if len(key) <= 3 and kind in CODED else 1 if len(key) <= 5 else MAX_DELETES


def bound_of(key: str) -> float:
    """Largest weighted distance that still means the same entry."""
    return 1.0 if len(key) <= 7 else 1.5 if len(key) <= 11 else 2.0


def fold_digits(key: str) -> str:
    """Digits inside words as the letters they stand for, 'rn' as 'm'."""
    return key.translate(str.maketrans("01569", "olsbg")).replace("rn", "m")


@lru_cache(200_000)
def weighted_distance(a: str, b: str) -> float:
    """Optimal string alignment with cheap look-alikes: 0.5 for a confused or doubled character or 'rn' for 'm', 1 for other edits."""
    n, m = len(a), len(b)
    before: list[float] = []
    last: list[float] = [float(j) for j in range(m + 1)]
    rows = [last]
    for i in range(1, n + 1):
        row = [float(i)] + [0.0] * m
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            best = last[j - 1] + (0.0 if x == y else 0.5 if frozenset((x, y)) in _CHEAP else 1.0)
            best = min(best, last[j] + (0.5 if i > 1 and a[i - 2] == x else 1.0), row[j - 1] + (0.5 if j > 1 and b[j - 2] == y else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, before[j - 2] + 1.0)
            if i > 1 and a[i - 2 : i] == "rn" and y == "m":
                best = min(best, before[j - 1] + 0.5)
            if j > 1 and b[j - 2 : j] == "rn" and x == "m":
                best = min(best, last[j - 2] + 0.5)
            row[j] = best
        before, last = last, row
        rows.append(row)
    return last[m]


class DeleteIndex:
    """The symmetric-delete dictionary of one or more reference lists."""

    def __init__(self, spellings: Iterable[tuple[str, int, str]], frequency: dict[int, int] | None = None):
        """``spellings``: (kind, id of the entry, spelling); the entry's own spelling comes first."""
        self.frequency = frequency or {}
        self.exact: dict[tuple[str, str], int] = {}
        cut: list[tuple[str, int, str]] = []
        for kind, entry, text in spellings:
            self.exact.setdefault((kind, key_of(text)), entry)
            cut.append((kind, entry, key_of(truncated(plain(text)))))
        for kind, entry, key in cut:
            if len(key) > 3:
                self.exact.setdefault((kind, key), entry)
        self.longest = max((len(key) for _, key in self.exact), default=0)
        self.deletes: dict[tuple[str, str], list[str]] = {}
        for kind, key in self.exact:
            for d in deletions(key, depth_of(key, kind)):
                self.deletes.setdefault((kind, d), []).append(key)

    def lookup(self, kind: str, value: str) -> tuple[int, float] | None:
        """(id, weighted distance) of the entry that a value denotes, None if there is none."""
        keys = keys_of(value, kind)
        for key in keys:
            if (entry := self.exact.get((kind, key))) is not None:
                return entry, 0.0
        best: tuple[float, int, int] | None = None
        for key in keys:
            if (entry := self.exact.get((kind, fold_digits(key)))) is not None:
                found = (0.5, -self.frequency.get(entry, 0), entry)
                best = found if best is None else min(best, found)
            if len(key) > self.longest + MAX_DELETES:
                continue  # further from every spelling than any is looked for
            met = {k for d in deletions(key, depth_of(key, kind)) for k in self.deletes.get((kind, d), ())}
            for other in met:
                distance = weighted_distance(key, other)
                if distance <= min(bound_of(key), bound_of(other)):
                    entry = self.exact[(kind, other)]
                    found = (distance, -self.frequency.get(entry, 0), entry)
                    best = found if best is None else min(best, found)
        return None if best is None else (best[2], best[0])


def spellings_of(reference: DataFrame, others: Iterable[tuple[str, str, str]] = ()) -> list[tuple[str, int, str]]:
    """The rows of :func:`spellings_table` on the driver, for lists known to be short."""
    return [(r["kind"], r["term_id"], r["spelling"]) for r in spellings_table(reference, others).orderBy("rank", "term_id", "spelling").collect()]


def spellings_table(reference: DataFrame, others: Iterable[tuple[str, str, str]] = ()) -> DataFrame:
    """(kind, term_id, spelling, rank) of a reference list (term_id, kind, term) and of other names (kind, entry, name).

    Entries of the list stay a table; only the fixed other names come from the driver.
    """
    spark = reference.sparkSession
    own = reference.where("term IS NOT NULL AND kind IS NOT NULL").select(F.col("kind").cast("string").alias("kind"), F.col("term_id").cast("int").alias("term_id"), F.col("term").cast("string").alias("spelling"))
    given = list(others)
    if not given:
        return own.withColumn("rank", F.lit(0))
    names = spark.createDataFrame(given, "kind string, entry string, name string")
    ids = own.groupBy("kind", F.col("spelling").alias("entry")).agg(F.min("term_id").alias("term_id"))
    more = names.join(ids, ["kind", "entry"]).select("kind", "term_id", F.col("name").alias("spelling"))
    return own.withColumn("rank", F.lit(0)).unionByName(more.withColumn("rank", F.lit(1)))


def _as_table(df: DataFrame, spellings: DataFrame | list[tuple[str, int, str]]) -> DataFrame:
    if isinstance(spellings, DataFrame):
        return spellings
    return df.sparkSession.createDataFrame([(*row, i) for i, row in enumerate(spellings)], "kind string, term_id int, spelling string, rank int")


def map_to_canonical(df: DataFrame, spellings: DataFrame | list[tuple[str, int, str]], kind: str = "kind", value: str = "value", frequency: DataFrame | None = None, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Add ``term_id``, the entry that ``value`` denotes in the list named by ``kind``, 0 if none, and ``term_cost``.

    ``spellings`` is a table as of :func:`spellings_table`, or a list of (kind, term_id, spelling), the first ones first;
    ``frequency`` (term_id, n) says how often entries occur.
    Nulls and blank values give null in both; an unknown kind denotes no entry (0); values are read whole, however long.
    Ties in distance go to the more frequent entry, then to the smaller id; of several entries with one spelling the one
    of the least ``rank``, then the smaller id, has it. Equal rows get equal results, none is dropped. An empty reference maps
    everything to 0. Existing columns of these names are replaced, others pass through.
    """
    # a key of n letters has about n * n / 2 deletions of up to two letters, of about 120 bytes and its own length each
    spellings = _as_table(df, spellings)
    n = F.length("spelling").cast("double")
    size = spellings.agg(F.coalesce(F.sum((n * n / 2 + n + 2) * (n + 120)), F.lit(0.0)).alias("bytes")).first()["bytes"]
    if size > limit:
        return map_by_join(df, spellings, kind, value, frequency)
    rows = [(r["kind"], r["term_id"], r["spelling"]) for r in spellings.orderBy("rank", "term_id", "spelling").collect()]
    often = {} if frequency is None else {r["term_id"]: r["n"] for r in frequency.join(spellings.select("term_id").distinct(), "term_id", "left_semi").select("term_id", "n").collect()}
    shared = df.sparkSession.sparkContext.broadcast(DeleteIndex(rows, often))

    @F.pandas_udf("struct<id int, cost float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], tuple[int | None, float | None]] = {}
        look = shared.value
        for kinds, values in batches:
            out = []
            for k, v in zip(kinds.astype(object), values.astype(object), strict=True):
                if not isinstance(v, str) or not v.strip():
                    out.append((None, None))
                    continue
                found = known.get((k, v))
                if found is None:
                    found = look.lookup(k, v) or (0, None)
                    if len(v) <= MEMO:
                        if len(known) > 200_000:
                            known.clear()
                        known[(k, v)] = found
                out.append(found)
            frame = pd.DataFrame(out, columns=["id", "cost"])
            yield frame.assign(id=frame["id"].astype("Int32"), cost=frame["cost"].astype("float32"))

    found = df.withColumn("_term", run(F.col(kind).cast("string"), F.col(value).cast("string")))
    return found.withColumn("term_id", F.col("_term.id")).withColumn("term_cost", F.col("_term.cost")).drop("_term")


def map_by_join(df: DataFrame, spellings: DataFrame | list[tuple[str, int, str]], kind: str = "kind", value: str = "value", frequency: DataFrame | None = None) -> DataFrame:
    """As :func:`map_to_canonical` for lists too long to broadcast: distinct values meet spellings by a join on deletions.

    Values are made distinct before anything is shuffled, and joined back by value; AQE splits a hot value's rows.
    Keys, deletions and distances are worked out in Arrow batches.
    """

    def batched(kind_of: str):
        def of(work):
            @F.pandas_udf(kind_of)
            def run(one: pd.Series, two: pd.Series) -> pd.Series:
                return pd.Series([work(x, y) for x, y in zip(one, two, strict=True)], dtype=object)

            return run

        return of

    deleted = batched("array<string>")(lambda key, k: sorted(deletions(key, depth_of(key, k or ""))))
    spelled = batched("array<struct<key: string, rank: int>>")(lambda text, k: [{"key": x, "rank": i} for i, x in enumerate([key_of(text), key_of(truncated(plain(text)))]) if len(x) > (3 if i else 0)])
    read = batched("array<struct<key: string, place: int>>")(lambda v, k: [{"key": x, "place": i} for i, x in enumerate(keys_of(v, k or ""))])
    near = batched("float")(lambda key, other: d if (d := weighted_distance(key, other)) <= min(bound_of(key), bound_of(other)) else None)

    # the entry of each spelling: whole spellings before those cut short, the least rank first, then the smaller id
    many = _as_table(df, spellings).withColumn("_s", F.explode(spelled("spelling", "kind"))).groupBy(F.col("kind").alias("_k"), F.col("_s.key").alias("_other"))
    many = many.agg(F.min(F.struct(F.col("_s.rank").alias("short"), "rank", F.col("term_id").alias("id"))).alias("_m")).select("_k", "_other", F.col("_m.id").alias("_id"))
    if frequency is None:
        many = many.withColumn("_freq", F.lit(0).cast("long"))
    else:
        many = many.join(frequency.select(F.col("term_id").alias("_id"), F.col("n").cast("long").alias("_freq")), "_id", "left").fillna(0, ["_freq"])
    values = df.select(F.col(kind).cast("string").alias("_k"), F.col(value).cast("string").alias("_v")).where("_v IS NOT NULL").distinct()
    values = values.withColumn("_x", F.explode(read("_v", "_k"))).select("_k", "_v", F.col("_x.key").alias("_key"), F.col("_x.place").alias("_place"))
    # equal spellings first, the whole value before its parts; then look-alike digits; then what deletions bring together
    exact = values.join(many, (values["_k"] == many["_k"]) & (values["_key"] == many["_other"])).select(values["_k"], "_v", "_id", "_freq", F.lit(0.0).cast("float").alias("_cost"), "_place")
    folds = F.regexp_replace(F.translate("_key", "01569", "olsbg"), "rn", "m")
    folded = values.withColumn("_fold", folds).join(many.withColumnRenamed("_other", "_fold"), ["_k", "_fold"]).select("_k", "_v", "_id", "_freq", F.lit(0.5).cast("float").alias("_cost"), F.lit(0).alias("_place"))
    longest = many.agg(F.coalesce(F.max(F.length("_other")), F.lit(0)).alias("n")).first()["n"]
    near_enough = values.where(F.length("_key") <= longest + MAX_DELETES)  # longer keys are further from every spelling than any is looked for
    met = near_enough.withColumn("_d", F.explode(deleted("_key", "_k"))).join(many.withColumn("_d", F.explode(deleted("_other", "_k"))), ["_k", "_d"]).select("_k", "_v", "_key", "_other", "_id", "_freq").distinct()
    close = met.where("_key <> _other").withColumn("_cost", near("_key", "_other")).where("_cost IS NOT NULL").select("_k", "_v", "_id", "_freq", "_cost", F.lit(0).alias("_place"))
    rank = F.struct("_cost", "_place", (-F.col("_freq")).alias("f"), F.col("_id").alias("id"))
    best = exact.unionByName(folded).unionByName(close).groupBy("_k", "_v").agg(F.min(rank).alias("_best")).select("_k", "_v", F.col("_best.id").alias("_id"), F.col("_best._cost").alias("_cost"))
    left = df.withColumn("_row_k", F.col(kind).cast("string")).withColumn("_row_v", F.col(value).cast("string"))
    out = left.join(best, (F.col("_row_k") == F.col("_k")) & (F.col("_row_v") == F.col("_v")), "left")
    blank = F.coalesce(F.col("_row_v").rlike(r"(?U)^\s*$"), F.lit(True))
    out = out.withColumn("term_id", F.when(~blank, F.coalesce("_id", F.lit(0)))).withColumn("term_cost", F.when(~blank, F.col("_cost")))
    return out.drop("_row_k", "_row_v", "_k", "_v", "_id", "_cost")
