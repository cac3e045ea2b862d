"""Column functions on labels and texts: canonical forms, predicates, label rewriting. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.session import python_trim

# Label words that mean the same, and words that mean nothing.
SYNONYMS = {
    "expiry": "exp", "expire": "exp", "expiration": "exp",
    "manufacture": "mfg", "manufacturing": "mfg", "manufactured": "mfg",
    "quantity": "qty", "weight": "qty", "wt": "qty", "netweight": "qty", "kg": "qty", "kgs": "qty", "kilogram": "qty", "kilograms": "qty",
    "number": "no", "numbers": "no", "lot": "batch", "date": "dt", "analytical": "ar", "report": "ar", "certificate": "coa", "analysis": "coa", "qualification": "test",
}
STOP_WORDS = ("of", "the", "a", "an")
MOLECULAR = ("formula", "molecular", "mol", "mw")
# Header labels that appear without a colon.
KNOWN_LABELS = (
    "quantity dispatched/sample quantity", "name of the product", "name of product", "product name", "material name", "batch/lot no", "batch/lot number", "batch no", "batch number", "lot no", "lot number",
    "batch size", "batch qty", "batch quantity", "mfg date", "date of mfg", "manufacturing date", "manufacture date", "date of manufacture", "date of manufacturing", "production date",
    "exp date", "date of exp", "expiry date", "date of expiry", "expiration date", "retest date", "re-test date", "date of retest", "date of sampling", "sampling date", "date of report", "report date",
    "date of analysis", "analysis date", "date of release", "release date", "analytical report no", "analysis report no", "a.r. no", "report no", "reporting date", "article no", "order no", "executive standard",
    "product", "quantity", "package", "packing",
)
# Words of dates to come and of signatures.
RETEST_WORDS = ("retest", "requalification", "recheck", "reevaluation", "reassessment", "reverification")
SIGNATURE_WORDS = ("signature", "sign here", "authorized", "authorised", "checked by", "approved by", "prepared by", "verified by", "qa manager", "qc manager", "analyst", "chemist", "authorised signatory", "authorized signatory")
# Roles of header cells by substring, the first that fits.
ROLES = (
    ("no", ("s no", "sr no", "sl no", "no")),
    ("result", ("result", "observation", "finding")),
    ("specification", ("specification", "limit", "standard", "acceptance")),
    ("parameter", ("test", "parameter", "particular", "characteristic", "item")),
)
# Wordings of one generic test.
TEST_PHRASES = (r"\bany\s+(?:single\s+|one\s+)?individual\s+impurity\b", r"\bany\s+single\s+impurity\b", r"\bmax(?:imum)?\s+individual\s+impurity\b", r"\blargest\s+(?:single\s+|individual\s+)?impurity\b")
# Labels of the two dates that stand in for each other.
EXPIRY_LABEL = r"Exp\.?\s*Date|Expiry\s*Date|Expiration\s*Date|Date\s+of\s+Exp(?:iry)?\.?"
RETEST_LABEL = r"Re-?\s*test\s*Date|Date\s+of\s+Re-?\s*test"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Column | str) -> Column:
    """The text, '' for null: absent values are '' by contract."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def normalize(x: Column | str) -> Column:
    """Lower case; anything but letters and digits of ASCII is one blank."""
    return F.trim(F.regexp_replace(F.lower(filled(x)), "[^a-z0-9]+", " "))


def words(x: Column | str) -> Column:
    return F.filter(F.split(_c(x), " "), lambda w: w != "")


def canonical_words(x: Column | str) -> Column:
    """Words of a normalized label with synonyms replaced and stop words left out, sorted, duplicates kept."""
    table = F.create_map(*[F.lit(v) for pair in SYNONYMS.items() for v in pair])
    kept = F.filter(words(x), lambda w: ~w.isin(*STOP_WORDS))
    return F.array_sort(F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), w)))


def canonical(x: Column | str) -> Column:
    return F.array_join(canonical_words(x), " ")


def differs_by_re(a: Column | str, b: Column | str) -> Column:
    """Whether two labels differ by a leading 're' of some words and nothing else: never spellings of one another."""
    pairs = F.arrays_zip(words(a).alias("x"), words(b).alias("y"))
    re_pair = lambda p: (p["x"] == F.concat(F.lit("re"), p["y"])) | (p["y"] == F.concat(F.lit("re"), p["x"]))
    return (F.size(words(a)) == F.size(words(b))) & F.forall(pairs, lambda p: (p["x"] == p["y"]) | re_pair(p)) & F.exists(pairs, re_pair)


def canonical_phrases(x: Column | str) -> Column:
    out = _c(x)
    for pattern in TEST_PHRASES:
        out = F.regexp_replace(out, f"(?i){pattern}", "single impurity")
    return out


def garbled(x: Column | str) -> Column:
    """Whether a text looks garbled: many words mix ASCII letters with letters of other kinds."""
    tokens = F.filter(F.split(filled(x), r"(?U)\s+"), lambda t: t != "")
    mixed = F.size(F.filter(tokens, lambda t: t.rlike("[A-Za-z]") & t.rlike(r"[\p{L}&&[^\x00-\x7F]]")))
    checked = F.size(F.filter(tokens, lambda t: t.rlike(r"\p{L}")))
    return (F.length(filled(x)) >= 50) & ((mixed >= 5) | ((checked > 20) & (mixed > 0.08 * checked)))


def looks_scanned(x: Column | str) -> Column:
    return F.length(python_trim(filled(x))) < 20


def expiry_label(n: Column | str) -> Column:
    return F.array_contains(words(n), "date") & F.arrays_overlap(words(n), F.array(*[F.lit(w) for w in ("exp", "expiry", "expiration")]))


def retest_label(n: Column | str) -> Column:
    return F.array_contains(words(n), "date") & F.replace(_c(n), F.lit(" "), F.lit("")).rlike("|".join(RETEST_WORDS))


def signature_label(x: Column | str) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in SIGNATURE_WORDS]), lambda w: F.contains(normalize(x), w))


def header_role(x: Column | str) -> Column:
    """Role of a header cell by substring, in order: 'no' inside any word comes first, as people have it."""
    n = normalize(x)
    out = None
    for role, keys in ROLES:
        hit = F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(n, k))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out


def bare_label(x: Column | str) -> Column:
    """The label of a cell 'label :' without a value, null otherwise."""
    text = python_trim(filled(x))
    label = python_trim(F.regexp_extract(text, r"(?s)^(.*?)\s*[:：]\s*(.*)$", 1))
    value = python_trim(F.regexp_extract(text, r"(?s)^(.*?)\s*[:：]\s*(.*)$", 2))
    return F.when(text.rlike("[:：]") & (value == "") & F.length(label).between(1, 60), label)


def known_label_pattern(phrase: str) -> str:
    """Words of a label with any separators between, not followed by a letter or digit."""
    parts = [w for w in "".join(c if c.isalnum() else " " for c in phrase.lower()).split()]
    return r"[\s./\-]*".join(parts) + r"(?![a-z0-9])"


KNOWN_LABEL = "(?i)(?:" + "|".join(known_label_pattern(p) for p in sorted(KNOWN_LABELS, key=lambda p: -len(p))) + ")"


def known_label(x: Column | str) -> Column:
    """The cell's text if it is a known label without a colon and nothing else, null otherwise."""
    text = python_trim(F.regexp_replace(python_trim(filled(x)), r"[.\-]+$", ""))
    return F.when((text != "") & ~text.rlike("[:：]") & (F.length(text) <= 45) & text.rlike(f"^{KNOWN_LABEL}$"), text)


def line_fields(line: Column | str) -> Column:
    """array<struct<label, value>> of a line 'Label: value   Label2: value2'; labels of 1 to 60 characters."""
    pattern = F.lit(r"([^\n:：]+?)[:：]\s*(.*?)(?=\s{2,}\S.*?[:：]|\s*$)")
    pairs = F.arrays_zip(F.regexp_extract_all(_c(line), pattern, 1).alias("label"), F.regexp_extract_all(_c(line), pattern, 2).alias("value"))
    found = F.transform(pairs, lambda p: F.struct(python_trim(p["label"]).alias("label"), p["value"].alias("value")))
    return F.filter(found, lambda p: F.length(p["label"]).between(1, 60))


def leading_label(line: Column | str, label: Column | str) -> Column:
    """The rest of a line that begins with a label without a colon, null if it doesn't or nothing is left.

    The label's own characters count, its blanks as any blanks and points.
    """
    n, key = normalize(line), normalize(label)
    parts = F.transform(F.split(filled(label), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1"))
    begin = F.concat(F.lit(r"(?iU)^\s*"), F.array_join(parts, r"[\s.]*"), F.lit(r"\s*[:\-]?\s*"))
    rest = F.regexp_replace(_c(line), begin, F.lit(""))
    return F.when((key != "") & F.startswith(n, F.concat(key, F.lit(" "))) & F.regexp_like(_c(line), begin) & ~rest.rlike("[:：]") & (rest != ""), rest)


def splice(text: Column | str, start: Column, end: Column, new: Column) -> Column:
    """The text with characters start to end (0-based, end excluded) replaced; unchanged unless start < end."""
    t = _c(text)
    return F.when(start < end, F.concat(F.substr(t, F.lit(1), start), new, F.substr(t, end + 1))).otherwise(t)


def replace_tail(text: Column | str, label: str, new: Column) -> Column:
    """What follows a label replaced, the label kept."""
    return F.regexp_replace(_c(text), F.lit(f"({label}).*$"), F.concat(F.lit("$1"), F.regexp_replace(new, r"([\\$])", r"\\$1")))


def relabel(x: Column | str, old: str, new: str) -> Column:
    """Labels ``old`` before a colon, or at the start of a line where the text has none, become ``new``, in the case of the old."""
    text = filled(x)
    upper = lambda t, tail: F.regexp_replace(t, rf"(?:{_upper(old)}){tail}", new.upper() + "$1")
    colon = F.regexp_replace(upper(text, r"(\s*[:：])"), rf"(?i)(?:{old})(?<!(?-i:{new.upper()}))(\s*[:：])", f"{new}$1")
    start = F.regexp_replace(F.regexp_replace(text, rf"(?m)^(\s*)(?:{_upper(old)})(?=\s|$)", "$1" + new.upper()), rf"(?im)^(\s*)(?:{old})(?<!(?-i:{new.upper()}))(?=\s|$)", "$1" + new)
    return F.when(text.rlike("[:：]"), colon).otherwise(start)


def _upper(pattern: str) -> str:
    """A pattern for the upper-case spelling; classes such as \\s stay."""
    out, escaped = [], False
    for c in pattern:
        out.append(c if escaped else c.upper())
        escaped = c == "\\" and not escaped
    return "".join(out).replace("(?:", "(?:")


def without_group(parameter: Column | str, group: Column | str) -> Column:
    """An item's own name: its text without the group's label in front (plural, brackets and dash aside)."""
    base = F.regexp_replace(python_trim(filled(group)), "s$", "")
    rest = python_trim(F.regexp_replace(filled(parameter), F.concat(F.lit(r"(?i)^\s*\Q"), base, F.lit(r"\Es?(?:\s*\([^)]*\))?\s*[-:]?\s*")), F.lit("")))
    return F.when(rest == "", filled(parameter)).otherwise(rest)


def named(name: Column | str, specification: Column | str) -> Column:
    """'name specification', or the one that isn't empty."""
    blank = lambda c: F.nullif(python_trim(filled(c)), F.lit(""))
    return F.concat_ws(" ", blank(name), blank(specification))


def holds_run(group_key: Column | str, item_key: Column | str) -> Column:
    """Whether an item's key holds the group's words in a row, plurals aside."""
    single = lambda k: F.array_join(F.transform(words(k), lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)), " ")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (_c(group_key) != "") & F.contains(pad(single(item_key)), pad(single(group_key)))


def containment(row_key: Column | str, item_key: Column | str) -> Column:
    """0.92 if the shorter of two keys stands in the longer as whole words (3 characters at least, 60 at most), else 0."""
    a, b = _c(row_key), _c(item_key)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.when((F.length(short) >= 3) & (F.length(long) <= 60) & F.contains(pad(long), pad(short)), 0.92).otherwise(0.0)


def leading(row_key: Column | str, item_key: Column | str) -> Column:
    """0.9 if a row's key (3 characters at least) begins an item's key as whole words, else 0."""
    return F.when((F.length(_c(row_key)) >= 3) & F.startswith(F.concat(_c(item_key), F.lit(" ")), F.concat(_c(row_key), F.lit(" "))), 0.9).otherwise(0.0)


def shipment_mode(value: Column | str, terms: Column | str) -> Column:
    """Air or Sea by substring, 'air' first wherever it stands; '' if neither."""
    text = F.lower(F.concat(filled(value), F.lit(" "), filled(terms)))
    return F.when(F.contains(text, F.lit("air")), "Air").when(text.rlike("sea|ocean|vessel|fcl|lcl"), "Sea").otherwise("")


def slug(name: Column | str) -> Column:
    """Letters and digits joined by dashes, 40 characters at most, 'customer' if nothing is left."""
    base = F.substring(F.regexp_replace(F.regexp_replace(F.lower(filled(name)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.when(base == "", "customer").otherwise(base)


def file_stem(product: Column | str) -> Column:
    kept = F.regexp_replace(python_trim(filled(product)), "[^A-Za-z0-9 _-]", "")
    return F.when(kept == "", "Product").otherwise(kept)


def padded(x: Column | str, width: int) -> Column:
    """Filled with blanks to a width, never cut."""
    return F.rpad(filled(x), F.greatest(F.length(filled(x)), F.lit(width)), F.lit(" "))


def text_lines(x: Column | str) -> Column:
    """The non-blank lines of a text."""
    return F.filter(F.split(filled(x), r"\R"), lambda t: python_trim(t) != "")


def fitted(lines: Column, slots: int, overflow: str = "join") -> Column:
    """Lines in a fixed number of slots: '' for missing ones, the overflow joined in the last, or dropped where a form has it so."""
    clean = F.filter(F.transform(lines, lambda t: python_trim(filled(t))), lambda t: t != "")
    few = F.slice(F.concat(clean, F.array_repeat(F.lit(""), slots)), 1, slots)
    many = F.concat(F.slice(clean, 1, slots - 1), F.array(F.array_join(F.slice(clean, F.lit(slots), F.greatest(F.size(clean), F.lit(1))), ", ")))
    return few if overflow == "drop" else F.when(F.size(clean) <= slots, few).otherwise(many)


def data_url(content: Column | str, path: Column | str) -> Column:
    """An image as a data URL, its type by the extension."""
    # Types by extension.
    types = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff"}
    kind = F.try_element_at(F.create_map(*[F.lit(v) for p in types.items() for v in p]), F.regexp_extract(F.lower(_c(path)), r"\.([^.]+)$", 1))
    return F.concat(F.lit("data:"), F.coalesce(kind, F.lit("image/png")), F.lit(";base64,"), F.regexp_replace(F.base64(_c(content)), r"\s", ""))


def sanitised(records: Column, keys: tuple[str, ...]) -> Column:
    """An array of structs with null texts as '', without null elements and those whose first key is empty."""
    clean = F.transform(F.filter(records, lambda r: r.isNotNull()), lambda r: F.struct(*[F.coalesce(r[k].cast("string"), F.lit("")).alias(k) for k in keys]))
    return F.filter(clean, lambda r: r[keys[0]] != "")


def valid_span(label: Column | str, value: Column | str) -> Column:
    """Whether a label of 1 to 60 characters has a value."""
    return F.length(filled(label)).between(1, 60) & (filled(value) != "")


def value_prefix(x: Column | str) -> Column:
    """struct<prefix, rest>: the colon with its blanks that begins a cell's value, which stays when the value changes, and the rest."""
    prefix = F.regexp_extract(filled(x), r"^\s*[:：]\s*", 0)
    return F.struct(prefix.alias("prefix"), F.substr(filled(x), F.length(prefix) + 1).alias("rest"))


def second_line(text: Column | str, new: Column | str) -> Column:
    """A text's second line replaced; without one what follows its last colon, else all of it."""
    t, n = filled(text), filled(new)
    lines = F.concat(F.split_part(t, F.lit("\n"), F.lit(1)), F.lit("\n"), n)
    return F.when(F.contains(t, F.lit("\n")), lines).when(F.contains(t, F.lit(":")), F.concat(F.regexp_extract(t, r"(?s)^(.*):", 1), F.lit(":  "), n)).otherwise(n)


# Pharmacopoeias that end a product's name.
PHARMACOPOEIAS = "EP|USP|BP|IP|JP|Ph\\.Eur\\."


def product_name(description: Column | str) -> Column:
    """A description up to its first pharmacopoeia; up to the first comma, bracket or line without one."""
    t = python_trim(filled(description))
    upto = F.regexp_extract(t, rf"^([^\n]*?\b(?:{PHARMACOPOEIAS}))(?:[^\w]|$)", 1)
    return F.when(upto != "", upto).otherwise(python_trim(F.regexp_extract(t, r"^([^,(\n]*)", 1)))
