"""Spellings of the same organisation, linked by exact radius joins in a metric space.

A name is taken apart (forms of address, branch notes, legal form, line of business) down to the words that are its
own. The folded own words, joined, are points of a metric space under the unrestricted Damerau-Levenshtein distance,
which is a true metric. Within a radius of 1, which names have, points meet by what one deletion leaves of them. For
larger radii pivots are drawn from the points; each point goes home to its nearest pivot and is copied to
every cell where the triangle inequality doesn't rule out a neighbour within the radius. Inside a cell, all pairs within
the radius are found exactly. Equal points collapse first, so copies cost nothing; links give components, with partial names (an initial or nothing
for a word) joined to the one full name that they can mean.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.operators.graph import connected_components
from waybill.session import cut

#: Distance between two spellings of one name.
RADIUS = 1
#: At most so many pivots, and strings for which one is drawn.
PIVOTS = 4096
PER_PIVOT = 400
#: Strings of a cell that one task joins; larger cells are joined by all tasks.
CELL_MOST = 50_000
#: Two own words joined that are shorter than this are compared with their initials and business as well.
LEAST_FULL = 11
#: Names of one own word are one organisation's if it has so many letters and differs in one of them.
LEAST_ALONE = 6

# Lines of business, as the words people write them with; longer ones first.
BUSINESSES = {
    "pharmaceutical industries": r"pharm(?:a|ac|aceuticals?)?\.?\s+ind(?:ustries|ustry|s)?\b\.?",
    "pharmaceuticals": r"pharm(?:a|ac|aceuticals?)?\b\.?",
    "trading": r"tr(?:a?di?n?g)\b\.?(?:\s+co(?:mpany)?\b\.?)?",
    "import export": r"imp(?:ort)?\b\.?\s*(?:and|&|/|\+|-)?\s*exp(?:ort)?\b\.?",
    "medical supplies": r"med(?:ical)?\b\.?\s+supp(?:lies|ly|l)?\b\.?",
    "drug store": r"drug\s?st(?:ore)?\b\.?",
    "healthcare products": r"h(?:ealth)?\s?/?\s?care\s+prod(?:ucts?|s)?\b\.?",
    "biotechnology": r"bio-?\s?tech(?:nology|n)?\b\.?",
    "laboratories": r"lab(?:oratories|oratory|'?ies|s)?\b\.?",
    "fine chemicals": r"f(?:ine)?\b\.?\s+chem(?:icals?|s)?\b\.?",
    "chemical works": r"chem(?:ical)?\b\.?\s+w(?:or)?ks\b\.?",
    "life sciences": r"life\s?sci(?:ences?)?\b\.?",
}
# Legal forms; longer ones first.
FORMS = {
    "private limited": r"\(?(?:private|pvt|p)\b\.?\)?\.?\s*(?:limi?ted|ltd)\b\.?",
    "limited": r"(?:limi?ted|ltd)\b\.?",
    "gmbh": r"g\.?\s?m\.?\s?b\.?\s?h\b\.?",
    "llc": r"l\.?\s?l\.?\s?c\b\.?",
    "sa": r"s\.?\s?a\b\.?(?!\w)",
    "holding": r"(?:holding|hldg)s?\b\.?",
    "corporation": r"corp(?:oration)?\b\.?",
    "incorporated": r"inc(?:orporated)?\b\.?",
    "ag": r"ag\b",
    "plc": r"plc\b\.?",
    "company": r"co(?:mp(?:any)?)?\b\.?",
}
_BUSINESS = [(k, re.compile(rf"(?<![a-z]){p}")) for k, p in BUSINESSES.items()]
_FORM = [(k, re.compile(rf"(?<![a-z.]){p}")) for k, p in FORMS.items()]
# What stands before or after a name without belonging to it.
_ADDRESS = re.compile(r"^\s*(?:(?:m/s|messrs|to|the|attn|c/o)\b[.:]?\s*)+")
_NOTE = re.compile(r"\((?:[^()]*)\)\s*$|[,\-–]\s*(?:import|export|purchase|head|branch|main)\s+(?:dept|department|office|division)\b\.?\s*$|\s_\s+\S+\s*$")
_FOR = re.compile(r"(?<![a-z])(?:(?:co|company)\b\.?\s+)?for\s+")


#: Scripts of which a sign is a syllable or a word, so that one edit makes another name.
_SYLLABIC = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


@dataclass(frozen=True)
class Parts:
    """A name taken apart: own words folded and as written, line of business and legal form ('' if not said)."""

    words: tuple[str, ...]
    raw: tuple[str, ...]
    business: str
    form: str


def letters_of(word: str) -> str:
    """Letters only, digits as the letters they look like."""
    return re.sub(r"[^a-z]", "", word.translate(str.maketrans("01569", "olsbg")))


def fold(word: str) -> str:
    """Letters only, with look-alikes, transliterations and doubled letters folded."""
    word = letters_of(word).replace("rn", "m").replace("ph", "f").replace("th", "t").replace("kh", "k").replace("ou", "u").replace("y", "i")
    return re.sub(r"(.)\1+", r"\1", word)


def take_apart(name: str) -> Parts:
    text = unicodedata.normalize("NFKD", name.replace("ß", "ss"))
    text = "".join(c for c in text if not unicodedata.combining(c))
    if re.fullmatch(r"[^A-Z]*|[^a-z]*", text) is None:
        text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)  # CamelCase
    text = text.lower().strip()
    text = _ADDRESS.sub("", text)
    while (shorter := _NOTE.sub("", text).strip()) != text and shorter:
        text = shorter
    text = re.sub(r"[_,;]|\s\.\s|\s-\s", " ", text)
    text = re.sub(r"\s+", " ", text)
    text = _FOR.sub(" ", text)
    business = form = ""
    for k, pattern in _BUSINESS:
        if m := pattern.search(text):
            business, text = k, f"{text[: m.start()]} | {text[m.end() :]}"
            break
    for k, pattern in _FORM:
        if found := list(pattern.finditer(text)):
            m = found[-1]
            form, text = k, f"{text[: m.start()]} {text[m.end() :]}"
            break
    words, raw = [], []
    for w in re.split(r"[^a-z0-9.]+|(?<=[a-z0-9]{3})\.", text):
        if w := w.strip("."):
            folded = fold(w)
            if folded and folded not in ("and", "of", "the"):
                words.append(folded)
                raw.append(letters_of(w))
    if not words:  # another script: its letters as they are
        words = raw = re.findall(r"[^\W\d_a-z]+", text)
    return Parts(tuple(words), tuple(raw), business, form)


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, lengths): strings as rows of small integers, padded with 0."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    wide = any(c > "\xff" for s in strings for c in s) if not all(map(str.isascii, strings)) else False
    kind, coding = (np.uint32, "utf-32-le") if wide else (np.uint8, "latin-1")
    out = np.zeros((len(strings), max(1, int(lengths.max(initial=0)))), dtype=kind)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode(coding), dtype=kind)
    return out, lengths


def distances(one: str, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of one string to many, vectorised over the many.

    With unit costs a swap never pays with letters between on both sides, so two running values, one along the row and
    one along the column, hold the best place to swap from; nothing is gathered.
    """
    n, m, many = len(one), letters.shape[1], len(letters)
    if many == 0:
        return np.zeros(0, dtype=np.int16)
    code = [ord(c) for c in one]
    kind, most, far = (np.uint8, 0xFF, 120) if n + m < 100 else (np.uint16, 0xFFFF, 30_000)
    columns = np.ascontiguousarray(letters.T)
    # by letter of ``one``: all bits where a column has another letter, so that an "or" makes a value too large to count
    other = {c: (columns != (c if c < 256 else np.uint32(c))).astype(kind) * kind(most) for c in set(code)}
    one_more = {c: o & kind(1) for c, o in other.items()}
    above = np.repeat(np.arange(m + 1, dtype=kind)[:, None], many, axis=1)
    before_above = np.full_like(above, far)
    from_row = np.full_like(above, far)  # by column: cost of a swap whose other letter stood in an earlier row
    for i in range(1, n + 1):
        c = code[i - 1]
        row = np.empty_like(above)
        row[0] = i
        from_column = np.full(many, far, dtype=kind)  # the same along this row
        for j in range(1, m + 1):
            best = np.minimum(above[j], row[j - 1], out=row[j])
            best += kind(1)
            np.minimum(best, above[j - 1] + one_more[c][j - 1], out=best)
            if i > 1 and j > 1:
                np.minimum(best, from_column | other[code[i - 2]][j - 1], out=best)
                np.minimum(best, from_row[j] | other[c][j - 2], out=best)
            # a swap of this letter with a later one: one edit, and one for each letter passed
            from_column += kind(1)
            if i > 1:
                np.minimum(from_column, (before_above[j - 1] + kind(1)) | other[c][j - 1], out=from_column)
            from_row[j] += kind(1)
            if j > 1:
                np.minimum(from_row[j], (above[j - 2] + kind(1)) | other[c][j - 1], out=from_row[j])
        before_above, above = above, row
    return above[lengths, np.arange(many)].astype(np.int16)


def one_edit(a: str, b: str) -> bool:
    """Whether the distance of two strings is at most 1."""
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    k = 0
    while k < n and k < m and a[k] == b[k]:
        k += 1
    if n == m:
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if n > m else a[k:] == b[k + 1 :]


def within(texts: list[str], probes: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(probe, other): all pairs within the radius of one cell, exactly.

    Strings within the radius share a string that deletions of up to that many letters leave; those that do are
    measured by the metric.
    """
    held: dict[str, list[int]] = {}
    for i in probes:
        for d in left_by_deletions(texts[i], radius):
            held.setdefault(d, []).append(i)
    for k, text in enumerate(texts):
        met = {i for d in left_by_deletions(text, radius) for i in held.get(d, ())}
        met.discard(k)
        if met and radius == 1:
            yield from ((i, k) for i in met if one_edit(texts[i], text))
        elif met:
            others = sorted(met)
            letters, lengths = encode([texts[i] for i in others])
            yield from ((i, k) for i, d in zip(others, distances(text, letters, lengths).tolist(), strict=True) if d <= radius)


def left_by_deletions(text: str, depth: int) -> set[str]:
    out, last = {text}, {text}
    for _ in range(depth):
        last = {t[:k] + t[k + 1 :] for t in last for k in range(len(t))}
        out |= last
    return out


def _join_large(cells: DataFrame, radius: int) -> DataFrame:
    """(a, b): as the join inside a cell, for cells that no task should hold: strings meet by what deletions leave.

    A deletion is shared by the strings that an insertion makes of it, some hundreds at most, however large the cell.
    """

    @F.pandas_udf("array<string>")
    def left(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(left_by_deletions(t, radius)) for t in texts])

    @F.pandas_udf("boolean")
    def near(one: pd.Series, two: pd.Series) -> pd.Series:
        if radius == 1:
            return pd.Series([one_edit(x, y) for x, y in zip(one, two, strict=True)], dtype=bool)
        return pd.Series([int(distances(x, *encode([y]))[0]) <= radius for x, y in zip(one, two, strict=True)], dtype=bool)

    opened = cells.withColumn("d", F.explode(left("s")))
    probes = opened.where("home").select("cell", "d", F.col("id").alias("x"), F.col("s").alias("xs"))
    met = probes.join(opened.select("cell", "d", F.col("id").alias("y"), F.col("s").alias("ys")), ["cell", "d"]).where("x <> y").select("x", "y", "xs", "ys").distinct()
    return met.where(near("xs", "ys")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _join_by_deletions(strings: DataFrame) -> DataFrame:
    """(a, b): ids of distinct strings (s, id) within one edit, exactly, at a cost in proportion to the strings.

    One edit apart, swaps too, strings share what a deletion of at most one letter leaves; those that do are measured.
    Only hashes of it are shuffled, and each string meets those before it that have the same, in one sort.
    """

    @F.pandas_udf("boolean")
    def near(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([one_edit(x, y) for x, y in zip(one, two, strict=True)], dtype=bool)

    n = F.length("s")
    without = lambda k: F.xxhash64(F.concat(F.substring("s", F.lit(1), k), F.substring("s", k + 2, n)))
    opened = strings.select("id", "s", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), n), without))).alias("d"))
    before = Window.partitionBy("d").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    met = opened.withColumn("others", F.collect_list(F.struct(F.col("id").alias("x"), F.col("s").alias("xs"))).over(before))
    pairs = met.where(F.size("others") > 0).select(F.col("id").alias("y"), F.col("s").alias("ys"), F.inline("others")).where("x <> y")
    return pairs.where(near("xs", "ys")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def metric_join(points: DataFrame, radius: int = RADIUS, per_pivot: int = PER_PIVOT, seed: int = 5, most: int = CELL_MOST) -> DataFrame:
    """(a, b), a < b: ids of points (id, s) whose strings are within the radius.

    Within a radius of 1 strings meet by deletions, without pivots: distances to pivots, whose number follows the
    strings', grow with the square of the data. For larger radii, pivots are a sample, one for ``per_pivot`` strings, at most ``PIVOTS`` (which bounds their broadcast); any choice
    gives the same links, only the cells differ. A cell of over ``most`` strings is joined by all tasks, exactly as well. Points with null or empty strings have no links. Equal strings collapse
    before the join and link as a star.

    A string goes home to its nearest pivot, the first of several. If x is at home with p, then d(x, p) <= d(x, q) for
    later and d(x, p) < d(x, q) for earlier pivots q, hence a string y within the radius of x has
    d(y, p) <= d(y, q) + 2 radius, less one for earlier q. Cells in which a string fails this hold no neighbour of it.
    """
    spark = points.sparkSession
    points = cut(points.select("id", "s").where("id IS NOT NULL AND s <> ''").distinct())
    strings = cut(points.groupBy("s").agg(F.min("id").alias("id")))
    stars = points.join(strings.select("s", F.col("id").alias("rep")), "s").where("id <> rep").select(F.least("rep", "id").alias("a"), F.greatest("rep", "id").alias("b"))
    if radius == 1:
        return _join_by_deletions(strings).unionByName(stars).distinct()
    wanted = min(PIVOTS, max(24, strings.count() // per_pivot))
    drawn = [r["s"] for r in strings.orderBy(F.xxhash64("s", F.lit(seed)), "s").select("s").limit(wanted).collect()]
    shared = spark.sparkContext.broadcast(drawn)
    reach = 2 * radius

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen = shared.value
        for batch in batches:
            texts, ids = batch["s"].to_numpy(), batch["id"].to_numpy()
            letters, lengths = encode(texts.tolist())
            d = np.stack([distances(p, letters, lengths) for p in chosen], axis=1) if len(texts) else np.zeros((0, len(chosen)), np.int16)
            least = d.min(axis=1, keepdims=True) if len(texts) else d
            earlier = np.minimum.accumulate(np.c_[np.full(len(d), 10_000, np.int16), d[:, :-1]], axis=1)
            row, cell = np.nonzero((d <= least + reach) & (d <= earlier + reach - 1))
            home = d.argmin(axis=1)[row] == cell if len(texts) else np.zeros(0, bool)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "home": home, "id": ids[row], "s": texts[row]})

    # short strings cost much time and few bytes: as many tasks as cores, however small the planner finds them
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = cut(strings.repartition(tasks, F.col("s")).mapInPandas(assign, "cell int, home boolean, id long, s string"))
    large = [r["cell"] for r in cells.groupBy("cell").count().where(F.col("count") > most).select("cell").collect()]  # of PIVOTS cells at most

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        ids, texts = frame["id"].tolist(), frame["s"].tolist()
        links = [(min(ids[i], ids[k]), max(ids[i], ids[k])) for i, k in within(texts, np.flatnonzero(frame["home"]).tolist(), radius) if ids[i] != ids[k]]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    small = cells.where(~F.col("cell").isin(large)) if large else cells
    links = small.groupBy("cell").applyInPandas(join, "a long, b long")
    if large:
        links = links.unionByName(_join_large(cells.where(F.col("cell").isin(large)), radius))
    return links.unionByName(stars).distinct()


def link_names(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, entity): the organisation that each distinct non-blank name denotes, as an id.

    Nulls, empty and blank names give no rows; repeated names one row; ties between full names that a partial name could
    mean leave it alone; very long names are read whole; an empty table gives an empty result; other columns are left out.
    Names without a-z letters are compared by the letters of their script. A name of one own word, or of short ones, that
    means no full name is linked to its like within the radius if it has ``LEAST_ALONE`` letters; with fewer, or in Han,
    Kana or Hangul, if its letters are equal.
    """
    distinct = names.select(F.col(name).cast("string").alias("name")).where(F.col("name").rlike(r"(?U)\S")).distinct()

    @F.pandas_udf("struct<words array<string>, raw array<string>, business string, form string>")
    def parts(series: pd.Series) -> pd.DataFrame:
        taken = [take_apart(x) for x in series]
        return pd.DataFrame({"words": [list(p.words) for p in taken], "raw": [list(p.raw) for p in taken], "business": [p.business for p in taken], "form": [p.form for p in taken]})

    taken = cut(distinct.withColumn("p", parts("name")).select("name", "p.words", "p.raw", "p.business", "p.form"))
    long_words = F.filter("words", lambda w: F.length(w) >= 3)
    joined = F.concat_ws("", long_words)
    taken = taken.withColumn("long", long_words).withColumn("initials", F.filter("words", lambda w: F.length(w) < 3)).withColumn("s", joined)
    full = (F.length("s") >= LEAST_FULL) & (F.size("initials") == 0)
    # names of equal own words, read in either order, are one node; the rest are nodes by all they say
    node = F.when(full, F.xxhash64(F.lit("full"), "s", "business")).otherwise(F.xxhash64(F.lit("part"), "long", "initials", "business", "form"))
    # other names of two own words are points too, with their initials and business as part of what is compared
    paired = ~full & (F.size("long") >= 2) & ~F.col("s").rlike(_SYLLABIC)
    # and those of one own word, or of short words only, written together
    together = F.concat_ws("", "words")
    alone = ~full & ~paired & (F.size("long") < 2) & (F.length(together) > 2) & F.exists("words", lambda w: F.length(w) > 1)
    taken = cut(taken.withColumn("full", full).withColumn("alone", alone).withColumn("point", full | paired | alone).withColumn("id", node))
    nodes = taken.select("id").distinct()
    fulls = taken.where("point").select("id", "s", "long", "initials", "raw", "business", "form", "full", "alone", "words")
    # points of a name: its own words joined as given, folded and as written; two words also in the other order, unless
    # they clearly stand longer word first, which then is the order in which the others are turned to meet them
    second, first = F.get("long", F.lit(1)), F.get("long", F.lit(0))
    turn = (F.size("long") == 2) & (F.length(first) < F.length(second) + 2)
    turned, as_written = F.when(turn, F.concat(second, first)), F.concat_ws("", "raw")
    written_turned = F.when(turn & (F.size("raw") == 2), F.concat(F.get("raw", F.lit(1)), F.get("raw", F.lit(0))))
    # more words in their alphabetical order, whatever the order they were written in
    sorted_words = F.when(F.size("long") > 2, F.concat_ws("", F.array_sort("long")))
    spelled = F.filter(F.array("s", turned, as_written, written_turned, sorted_words), lambda x: x.isNotNull())
    single = F.filter(F.col("words"), lambda w: F.length(w) == 1)
    whole = F.concat_ws("", F.filter("words", lambda w: F.length(w) > 1))
    # what must be equal stands twice, so that one letter is two edits
    whole = F.when((F.length(whole) >= LEAST_ALONE) & ~whole.rlike(_SYLLABIC), whole).otherwise(F.concat(whole, F.lit("="), whole))
    spelled = F.when(F.col("alone"), F.array(whole)).otherwise(spelled)
    said = F.concat(F.lit("|"), F.concat_ws(" ", F.when(F.col("alone"), single).otherwise(F.col("initials"))), F.lit("|"), "business")
    # the shortest full names also meet those a letter shorter
    short = F.when(F.col("full") & (F.length("s") > LEAST_FULL), F.array().cast("array<string>")).otherwise(F.transform(spelled, lambda x: F.concat(x, said)))
    points = fulls.select("id", F.explode(F.array_distinct(F.concat(F.when(F.col("full"), spelled).otherwise(F.array().cast("array<string>")), short))).alias("s"))
    says = lambda a, b: (a == "") | (b == "") | (a == b)
    # a name of one own word meets its like only, and agrees in what it says of its legal form; full names have no form in their node
    line = fulls.groupBy("id").agg(F.first("business").alias("business"), F.first("alone").alias("alone"), F.when(F.first("alone"), F.first("form")).otherwise("").alias("form"))
    of = lambda k: line.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("business", "alone", "form")])
    links = metric_join(points).join(of("a"), "a").join(of("b"), "b").where(F.col("alone_a") == F.col("alone_b"))
    links = links.where(says(F.col("business_a"), F.col("business_b")) & says(F.col("form_a"), F.col("form_b")))
    entities = cut(connected_components(nodes, links.select("a", "b")))
    if_full = cut(fulls.where((F.size("initials") == 0) & ~F.col("alone")).join(entities, "id").select("component", "long", "business", "form").distinct())

    # partial names: the own word they have meets a word of a full name, and whatever else they say agrees
    heads = if_full.where(F.size("long") >= 2).select("component", "business", "form", F.posexplode("long").alias("at", "word"), "long").withColumn("others", F.expr("filter(long, (w, i) -> i <> at)"))
    some = taken.where(~F.col("full")).where(F.size("long") == 1).select("id", F.get("long", F.lit(0)).alias("word"), F.get("initials", F.lit(0)).alias("initial"), "business", "form").distinct()
    words = heads.select("word").unionByName(some.select("word")).distinct().withColumn("id", F.xxhash64("word"))
    close = metric_join(words.select("id", F.col("word").alias("s")))
    near = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(words.select(F.col("id").alias("a"), F.col("id").alias("b")))
    meant = (
        some.withColumn("a", F.xxhash64("word"))
        .join(near, "a")
        .join(heads.select("component", F.col("business").alias("b2"), F.col("form").alias("f2"), "others", F.xxhash64("word").alias("b")), "b")
        .where(says(F.col("business"), F.col("b2")) & says(F.col("form"), F.col("f2")) & (F.col("initial").isNull() | F.exists("others", lambda w: w.startswith(F.col("initial")))))
        .withColumn("distance", F.when(F.col("a") == F.col("b"), 0).otherwise(1))
    )
    # the nearest spelling decides; if it is several organisations', a word that agrees in the legal form as well
    best = meant.groupBy("id", "distance").agg(F.collect_set("component").alias("all"), F.collect_set(F.when((F.col("form") != "") & (F.col("form") == F.col("f2")), F.col("component"))).alias("same"))
    best = best.groupBy("id").agg(F.min_by(F.struct("all", "same"), "distance").alias("x"))
    # one that may mean several organisations is linked to none, nor to other names of its kind
    only = F.when(F.size("x.all") == 1, F.get("x.all", F.lit(0))).when(F.size("x.same") == 1, F.get("x.same", F.lit(0)))
    chosen = best.select("id", F.coalesce(only, F.col("id")).alias("entity"))
    found = taken.select("name", "id").join(entities, "id").join(chosen, "id", "left")
    return found.select("name", F.coalesce("entity", "component").alias("entity"))


def pairs_of_names(entities: DataFrame, per_salt: int = 500) -> DataFrame:
    """(name_a, name_b), name_a < name_b by code point: pairs of names of one entity.

    The pairs of an entity are spread over one task for each ``per_salt`` of its names.
    """
    salted = entities.join(entities.groupBy("entity").agg(F.ceil(F.count("*") / per_salt).cast("int").alias("_salts")), "entity")
    one = salted.select("entity", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), F.col("_salts")).cast("int").alias("_salt"))
    two = salted.select("entity", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    return one.join(two, ["entity", "_salt"]).where("name_a < name_b").select("name_a", "name_b")
