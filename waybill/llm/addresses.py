"""Which address records denote the same place, numbers first.

Addresses are cut, with SQL expressions only, into digit tokens by role (numbers of the house, box, postcode) and the few
words that tell a place (street, city); kinds of streets, districts, countries and directions are left out. Equal token
sets collapse into one *place form* before anything is compared, so a place with a third of all rows counts once per form.

Forms are compared inside blocks of their sorted house numbers plus one word, whole or with one letter deleted, which
brings words within one edit together whichever letter is misspelt, or plus the postcode. Only ids go through the blocks;
pairs are made distinct before tokens are joined to them: ``array_intersect`` gives the words in common, unmatched words
are matched by ``levenshtein``, and a pair is accepted if what matches has enough of the weight of rarity. Links give
components. A post box and a street address become one place where a record of the trusted side gives both. Blocks hold
forms of one number and one word, that is a place and its misspellings, not its records.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.lexicon import aliases
from waybill.operators.graph import connected_components
from waybill.session import cut

# Words of addresses that don't tell a place.
KINDS = "street str avenue ave boulevard boul blvd blv lane square sqr road building bldg block house number postbox post box pobox"
DISTRICTS = "second first third ring garden quarter lower upper market station area airport airpt zone university univ district dist industrial north south east west free old port"
NOISE = "near opp opposite behind next ground floor warehouse central stn depot mosque new bus strasse strase straat"
OTHER_KINDS = "улица ул дом город г проспект пр шоссе переулок شارع طريق مبنى"
_ACCENTS = ("áàâäãåéèêëíìîïóòôöõøúùûüñçßğşıčěšžřýůł", "aaaaaaeeeeiiiioooooouuuuncsgsiceszryul")

#: A box, however written; its number is the last group.
BOX = r"(?:\bp\s*\.?\s*o\s*\.?\s*b(?:\s*ox\b|\b)|\bpost\s*(?:office\s*)?box\b|\bpob\b)[^0-9a-z]{0,5}(?:no\b|number\b|nr\b)?[^0-9a-z]{0,5}(\d+)"
STRAY = r"\b(?:ground|first|second|third|\d+(?:st|nd|rd|th))\s+fl(?:oor|r)?\b\.?|\bfloor\s+\d+\b|\b(?:warehouse|gate|unit|suite|room|dock)\s*(?:no\b\.?)?\s*\d+|(?:\bnear|\bopp\b\.?|\bopposite|\bbehind|\bnext\s+to)\s[^,;/|\n]*"
#: Share of the weight of rarity that must match.
ACCEPT = 0.7
#: Edits between two spellings of a word.
EDITS = 2
#: What ends a street's name when it is one word with its kind.
STREET_END = r"(?<=[a-z]{3})(?:stras?se|straat|str)\b"


def _stop_words() -> list[str]:
    words = set(f"{KINDS} {DISTRICTS} {NOISE}".split())
    for kind, entry, name in aliases():
        if kind == "country":
            words |= set(f"{entry} {name}".lower().translate(str.maketrans(*_ACCENTS)).replace(".", " ").replace("(", " ").replace(")", " ").replace("'", " ").split())
    return sorted({w for w in words if len(w) >= 4} | set(OTHER_KINDS.split()))


def place_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, numbers, box, post, words) of each address; the first line of the text is the resident's name.

    ``numbers`` are the sorted distinct house numbers (of one to four digits). A number of five or six digits is the
    postcode; without one, the last of several numbers that has four digits. ``post`` and ``box`` are null where there is
    none. ``words`` are sorted and distinct, in any script; spellings of 'ph' and 'f' are folded.
    """
    body = F.regexp_replace(F.col(text).cast("string"), r"^[^\n]*\n?", "")
    plain = F.translate(F.lower(body), *_ACCENTS)
    some = lambda c: F.nullif(c, F.lit(""))
    stop = F.array(*[F.lit(w) for w in ["", *_stop_words()]])
    letters = F.regexp_replace(F.regexp_replace("_t", r"[^\p{L}\p{M}]+", " "), STREET_END, "")
    four = F.filter("_short", lambda n: F.length(n) == 4)
    is_post = F.col("_long").isNull() & (F.size("_short") > 1) & (F.size(four) > 0)
    last_four = F.element_at(four, -1)
    return (
        df.select(F.col(key).alias(key), plain.alias("_t"))
        .withColumn("_box", some(F.regexp_extract("_t", BOX, 1)))
        .withColumn("_t", F.regexp_replace("_t", BOX, " | "))
        .withColumn("_t", F.regexp_replace("_t", STRAY, " | "))
        .withColumn("_long", some(F.regexp_extract("_t", r"(?<!\d)(\d{5,6})(?!\d)", 1)))
        .withColumn("_short", F.regexp_extract_all("_t", F.lit(r"(?<!\d)0*([1-9]\d{0,3}|0)(?!\d)"), F.lit(1)))
        .withColumn("_post", F.when(is_post, last_four).otherwise(F.col("_long")))
        .withColumn("_numbers", F.array_sort(F.array_distinct(F.when(is_post, F.array_remove("_short", last_four)).otherwise(F.col("_short")))))
        .withColumn("_words", F.array_sort(F.array_except(F.split(F.regexp_replace(F.regexp_replace(letters, r"(?<![a-z])[a-z]{1,3}(?![a-z])", ""), "ph", "f"), " +"), stop)))
        .select(key, F.coalesce("_numbers", F.array().cast("array<string>")).alias("numbers"), F.col("_box").alias("box"), F.col("_post").alias("post"), F.coalesce("_words", F.array().cast("array<string>")).alias("words"))
    )


def _close(a, b):
    """Whether two words are spellings of one: within two edits, or one for short words."""
    return F.levenshtein(a, b, EDITS).between(0, F.when(F.least(F.length(a), F.length(b)) >= 6, EDITS).otherwise(1))


def _similar(pairs: DataFrame) -> DataFrame:
    """Keep pairs (a_words, b_words, a_post, b_post, weights by word in a_weight and b_weight) that denote one place."""
    weight = lambda m, w: F.coalesce(F.try_element_at(m, w), F.lit(1.0))
    total = lambda words, m: F.aggregate(words, F.lit(0.0), lambda s, w: s + weight(m, w))
    pairs = pairs.withColumn("_common", F.array_intersect("a_words", "b_words")).withColumn("_left", F.array_except("a_words", "b_words")).withColumn("_right", F.array_except("b_words", "a_words"))
    pairs = pairs.withColumn("_met", F.filter("_left", lambda x: F.exists("_right", lambda y: _close(x, y)))).withColumn("_met_r", F.filter("_right", lambda y: F.exists("_left", lambda x: _close(x, y))))
    same_post = F.col("a_post").isNotNull() & (F.col("a_post") == F.col("b_post"))
    post = F.when(same_post, F.col("post_weight")).otherwise(0.0)
    # a misspelt word is rare because it is misspelt: matched words weigh as their more frequent spelling
    met = F.least(total(F.col("_met"), F.col("a_weight")), total(F.col("_met_r"), F.col("b_weight")))
    matched = total(F.col("_common"), F.col("a_weight")) + met + post
    alone = total(F.array_except("_left", "_met"), F.col("a_weight")) + total(F.array_except("_right", "_met_r"), F.col("b_weight"))
    return pairs.where((matched > 0) & (matched >= ACCEPT * (matched + alone)))


def _with_one_deleted(word):
    """The word and what it is without each of its letters."""
    return F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))


def _blocks(forms: DataFrame) -> DataFrame:
    """(id, block) of forms (id, numbers, post, words): the sorted numbers, and each alone, with each word or the postcode."""
    numbers = F.array_distinct(F.concat(F.array(F.array_join("numbers", "-")), "numbers"))
    words = F.array_distinct(F.flatten(F.transform("words", _with_one_deleted)))
    marks = F.concat(words, F.filter(F.array(F.concat(F.lit("#"), F.col("post"))), lambda x: x.isNotNull()))
    opened = forms.select("id", F.explode(numbers).alias("_n"), marks.alias("_m")).select("id", "_n", F.explode("_m").alias("_m"))
    return opened.select("id", F.xxhash64("_n", "_m").alias("block"))


def same_places(records: DataFrame, key: str, text: str, trusted: str) -> DataFrame:
    """(key, place): every place that each record's address denotes; records that share a place denote the same building.

    ``trusted`` names a boolean column: where a trusted record gives a box and a street, they are one place. A record
    may denote two places (a street and a box that no trusted record joins). An address that leaves out a number, or a
    box without a city, counts as the place it can mean only if that is one place; it never joins two.

    Null, empty and one-line texts and those without a number beside a word denote no place. Repeated rows collapse; ties
    have no part in it; long texts are read whole; an empty table gives an empty result; other columns are left out.
    """
    tokens = place_tokens(records.select(F.struct(F.col(key), F.col(trusted)).alias("_key"), F.col(text).alias("_text")), "_key", "_text")
    tokens = tokens.select(F.col(f"_key.{key}").alias(key), F.col(f"_key.{trusted}").alias("_trusted"), "numbers", "box", "post", "words")
    has_street = (F.size("numbers") > 0) & (F.size("words") > 0)
    street_id = F.when(has_street, F.xxhash64(F.lit("street"), "numbers", F.coalesce("post", F.lit("")), "words"))
    box_id = F.when(F.col("box").isNotNull(), F.xxhash64(F.lit("box"), "box", "words"))
    tokens = cut(tokens.withColumn("street", street_id).withColumn("at_box", box_id).where("street IS NOT NULL OR at_box IS NOT NULL"))

    # place forms, each once, with the weights of rarity of their words over all records
    streets = tokens.where("street IS NOT NULL").groupBy(F.col("street").alias("id")).agg(F.first("numbers").alias("numbers"), F.first("post").alias("post"), F.first("words").alias("words"), F.count("*").alias("n"))
    boxes = tokens.where("at_box IS NOT NULL").groupBy(F.col("at_box").alias("id")).agg(F.first("box").alias("box"), F.first("words").alias("words"))
    streets = cut(streets)
    rows = tokens.count()
    frequency = streets.select("n", F.explode("words").alias("word")).groupBy("word").agg(F.sum("n").alias("df"))
    rarity = F.greatest(F.lit(0.1), F.log(F.lit(float(max(rows, 2))) / F.col("df")))
    weights = streets.select("id", F.explode("words").alias("word")).join(frequency, "word").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", rarity.alias("r")))).alias("weight"))
    weighted = cut(streets.drop("n").join(weights, "id"))

    blocks = _blocks(weighted)
    met = blocks.select("block", F.col("id").alias("a")).join(blocks.select("block", F.col("id").alias("b")), "block").where("a < b").select("a", "b").distinct()
    of = lambda k: weighted.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("numbers", "post", "words", "weight")])
    post_weight = F.lit(math.log(max(rows, 2)) / 2)
    similar = _similar(met.join(of("a"), "a").join(of("b"), "b").withColumn("post_weight", post_weight))
    common = F.size(F.array_intersect("a_numbers", "b_numbers"))
    similar = cut(similar.select("a", "b", "a_numbers", "b_numbers").where(common == F.least(F.size("a_numbers"), F.size("b_numbers"))))
    alike = F.col("a_numbers") == F.col("b_numbers")
    street_links = similar.where(alike).select("a", "b")
    # a form that leaves out a number may mean one with more of them, if all those have the same
    less = F.size("a_numbers") < F.size("b_numbers")
    short = similar.where(~alike).select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("b"), F.when(less, F.col("b_numbers")).otherwise(F.col("a_numbers")).alias("_more"))
    only = short.groupBy("a").agg(F.count_distinct("_more").alias("_n")).where("_n = 1").select("a")
    street_links = street_links.unionByName(short.join(only, "a").select("a", "b"))

    # a box number is rare by itself: forms of one number agree if a word does
    told = boxes.where(F.size("words") > 0)
    one, two = told.select("box", F.col("id").alias("a"), F.col("words").alias("a_words")), told.select("box", F.col("id").alias("b"), F.col("words").alias("b_words"))
    agree = F.exists("a_words", lambda x: F.exists("b_words", lambda y: _close(x, y)))
    box_links = one.join(two, "box").where("a < b").where(agree).select("a", "b")

    joined = tokens.where(F.col("_trusted") & F.col("street").isNotNull() & F.col("at_box").isNotNull()).select(F.col("street").alias("a"), F.col("at_box").alias("b")).distinct()
    nodes = streets.select("id").unionByName(told.select("id"))
    places = cut(connected_components(nodes, street_links.unionByName(box_links).unionByName(joined)))
    # a box without a city is the one place that has it, or a place of its own
    untold = boxes.where(F.size("words") == 0).select("id", "box")
    owners = told.select("id", "box").join(places, "id").groupBy("box").agg(F.min("component").alias("_least"), F.max("component").alias("_most"))
    alone = untold.join(owners, "box", "left").select("id", F.when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise(F.col("id")).alias("component"))
    member = tokens.select(key, F.explode(F.filter(F.array("street", "at_box"), lambda x: x.isNotNull())).alias("id")).distinct()
    return member.join(places.unionByName(alone), "id").select(key, F.col("component").alias("place")).distinct()


def pairs_of_places(places: DataFrame, key: str, wanted: str, per_salt: int = 500) -> DataFrame:
    """(key_a, key_b), key_a < key_b: pairs of records that share a place, at least one of them ``wanted`` (a prefix).

    Pairs are the result asked for; the pairs of a place are spread over one task for each ``per_salt`` of its records.
    """
    salted = places.join(places.groupBy("place").agg(F.ceil(F.count("*") / per_salt).cast("int").alias("_salts")), "place")
    first = salted.where(F.col(key).startswith(wanted)).select("place", F.col(key).alias("_w"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    other = salted.select("place", F.col(key).alias("_o"), F.pmod(F.xxhash64(key), F.col("_salts")).cast("int").alias("_salt"))
    met = first.join(other, ["place", "_salt"]).where((F.col("_w") != F.col("_o")) & (~F.col("_o").startswith(wanted) | (F.col("_w") < F.col("_o"))))
    return met.select(F.least("_w", "_o").alias("key_a"), F.greatest("_w", "_o").alias("key_b")).distinct()
