"""Extracted fields and results matched to the slots and rows of templates.

Everything is keyed by document, so a plan is one exchange on ``doc_id`` however many documents there are; what is
compared inside a document are its own fields only.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from waybill.functions import text as T
from waybill.session import python_trim

#: Least likeness of two labels, and of a template row and a result.
LABEL_CUTOFF = 0.72
ROW_CUTOFF = 0.55


@F.pandas_udf(DoubleType())
def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of matching blocks (Ratcliff and Obershelp); not symmetric, the second text is the one looked up."""
    known: dict[tuple[str, str], float] = {}
    matcher = difflib.SequenceMatcher()
    for a, b in batches:
        out = []
        for x, y in zip(a, b, strict=True):
            if (x, y) not in known:
                if len(known) > 200_000:
                    known.clear()
                matcher.set_seqs(x or "", y or "")
                known[(x, y)] = matcher.ratio()
            out.append(known[(x, y)])
        yield pd.Series(out, dtype="float64")


def candidates(fields: DataFrame) -> DataFrame:
    """(doc_id, key, ord, value): a document's fields by normalized label; the first place and the last value count."""
    n = fields.withColumn("key", T.normalize("label"))
    return n.groupBy("doc_id", "key").agg(F.min("field_ix").alias("ord"), F.max_by("value", "field_ix").alias("value"))


def best_matches(slots: DataFrame, fields: DataFrame, cutoff: float = LABEL_CUTOFF, by: tuple[str, ...] = ("doc_id", "slot_ix")) -> DataFrame:
    """Slots (doc_id, slot_ix, label), one for each ``by``, with the ``key``, ``value`` and ``tier`` of the field that fits best, null if none does.

    Tiers, the first that fits: 0 equal, 1 equal words after synonyms, 2 the only one whose words hold or are held,
    3 likeness of spelling among the three likest unless only a 're' differs, 4 words in common, 5 the only weight or quantity.
    An empty label fits nothing; null labels count as empty. Both sides grow with the documents, so the join is a merge,
    whatever the planner makes of the bytes stored.
    """
    q = slots.withColumn("query", T.normalize("label"))
    keys = candidates(fields).select("doc_id", "key", "ord", F.col("value").alias("_value"))
    prepared = keys.withColumn("k_canon", T.canonical_words("key")).withColumn("k_set", F.array_distinct("k_canon")).withColumn("k_words", F.array_distinct(T.words("key"))).withColumn("_anchor", F.min("ord").over(Window.partitionBy("doc_id")) == F.col("ord"))
    queries = q.withColumn("q_canon", T.canonical_words("query")).withColumn("q_set", F.array_distinct("q_canon")).withColumn("q_words", F.array_distinct(T.words("query")))
    of = prepared.withColumnRenamed("doc_id", "_doc").hint("merge")
    pairs = queries.join(of, (F.col("doc_id") == F.col("_doc")) & (F.col("query") != ""), "left")
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    pairs = (
        pairs.withColumn("e0", F.col("query") == F.col("key"))
        .withColumn("e1", (F.size("q_canon") > 0) & (F.col("q_canon") == F.col("k_canon")))
        .withColumn("e2", (F.size("q_set") > 0) & (F.size("k_set") > 0) & (within("q_set", "k_set") | within("k_set", "q_set")))
        .withColumn("s3", ratio("key", "query"))
        .withColumn("s4", F.when((F.size("q_words") > 0) & (F.size("k_words") > 0), F.size(F.array_intersect("q_words", "k_words")) / F.least(F.size("q_words"), F.size("k_words"))).otherwise(0.0))
        .withColumn("q5", F.array_contains("q_canon", "qty") & F.array_contains("k_canon", "qty"))
        .withColumn("m5", F.arrays_overlap("k_canon", F.array(*[F.lit(w) for w in T.MOLECULAR])))
        .withColumn("re", T.differs_by_re("query", "key"))
    )
    # only pairs that may fit or count are shuffled, and one for each slot, so that none is lost; no count or rank of
    # those that may fit depends on the others
    may_fit = F.col("e0") | F.col("e1") | F.col("e2") | (F.col("s3") >= cutoff) | (F.col("s4") >= 0.8) | F.col("q5")
    pairs = pairs.where(F.col("key").isNull() | F.col("_anchor") | F.coalesce(may_fit, F.lit(False))).select(*slots.columns, "key", "ord", "_value", "e0", "e1", "e2", "s3", "s4", "q5", "m5", "re")
    slot = Window.partitionBy(*by)
    ranked = slot.orderBy(F.desc("s3"), F.desc("key"))
    n5 = F.count_if(F.col("q5") & ~F.col("m5")).over(slot)
    tier = (
        F.when(F.col("key").isNull(), None)
        .when(F.col("e0"), 0)
        .when(F.col("e1"), 1)
        .when(F.col("e2") & (F.count_if("e2").over(slot) == 1), 2)
        .when((F.col("s3") >= cutoff) & (F.row_number().over(ranked) <= 3) & ~F.col("re"), 3)
        .when(F.col("s4") >= 0.8, 4)
        .when(F.col("q5") & ((~F.col("m5") & (n5 == 1)) | ((n5 == 0) & (F.count_if("q5").over(slot) == 1))), 5)
    )
    order = slot.orderBy(F.asc_nulls_last("tier"), F.when(F.col("tier") == 3, -F.col("s3")).when(F.col("tier") == 4, -F.col("s4")).otherwise(0.0), F.when(F.col("tier") == 3, F.rank().over(ranked)).otherwise(F.col("ord")))
    best = pairs.withColumn("tier", tier).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    fits = lambda c: F.when(F.col("tier").isNotNull(), F.col(c))
    return best.select(*by, *[c for c in slots.columns if c not in by], fits("key").alias("key"), fits("_value").alias("value"), "tier")


def begun_lines(lines: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, p): each document's paragraphs of lines (slot_ix, label) with the fields (key, value) whose own label begins
    them, in the fields' order. The last value of a label counts."""
    last = F.max_by("value", "field_ix").over(Window.partitionBy("doc_id", "key"))
    own = fields.withColumn("key", T.normalize("label")).select(F.col("doc_id").alias("_doc"), "field_ix", "key", F.col("label").alias("_own"), last.alias("value"))
    begun = lines.select("doc_id", "para_ix", "slot_ix", "label").join(own.hint("merge"), F.col("doc_id") == F.col("_doc"), "left")
    key = F.when(T.leading_label("label", "_own").isNotNull() & F.col("key").isNotNull(), F.struct("field_ix", "key", "value"))
    line = begun.groupBy("doc_id", "para_ix", "slot_ix", "label").agg(F.array_sort(F.collect_set(key)).alias("k"))
    each = F.struct(F.col("slot_ix").cast("bigint").alias("slot_ix"), "label", F.transform("k", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("keys"))
    return line.groupBy("doc_id", "para_ix").agg(F.collect_list(each).alias("l")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_ix", "l"))).alias("p"))


def fill_slots(inline: DataFrame, bare: DataFrame, known: DataFrame, fields: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(doc_id, pass, slot_ix, label, key, new_value, action) of a template's header slots.

    Passes in order: slots 'label: value' are filled or cleared, and may share a field; lines 'label value' (as ``label``,
    with ``para_ix``) that a field not used so far begins are filled, others kept; bare labels are filled with fields not
    used so far, kept if theirs is used, by an earlier slot of theirs too, and cleared if they have none; labels known
    without a colon are filled or cleared. ``slot_ix`` is the order in the document.

    A line takes the first field that begins it and isn't used by a slot of pass 1 nor in a paragraph before; of the
    lines of one paragraph that take the same field the last has it. All slots are matched at once, and the passes are
    one fold over each document's own slots, so that fields are read once for the slots and once for the lines.
    """
    slots = [s.select("doc_id", F.lit(k).alias("pass"), F.col("slot_ix").cast("bigint").alias("slot_ix"), "label") for k, s in ((1, inline), (3, bare), (4, known))]
    matched = best_matches(slots[0].unionByName(slots[1]).unionByName(slots[2]), fields, by=("doc_id", "pass", "slot_ix"))
    docs = matched.groupBy("doc_id").agg(F.collect_list(F.struct("pass", "slot_ix", "label", "key", "value")).alias("m"))
    if lines is None:
        docs = docs.withColumn("p", F.expr("cast(array() as array<struct<para_ix: int, l: array<struct<slot_ix: bigint, label: string, keys: array<struct<key: string, value: string>>>>>>)"))
    else:
        docs = docs.join(begun_lines(lines, fields).hint("merge"), "doc_id", "full_outer").select("doc_id", *[F.coalesce(c, F.array()).alias(c) for c in ("m", "p")])
    docs = docs.withColumn("used", F.expr("transform(filter(m, x -> x.pass = 1 AND x.key IS NOT NULL), x -> x.key)"))
    led = """
        aggregate(p, cast(array() as array<struct<slot_ix: bigint, f: struct<key: string, value: string>>>), (acc, x) -> concat(acc,
            transform(array(transform(x.l, y -> named_struct('slot_ix', y.slot_ix, 'f', get(filter(y.keys, k -> NOT array_contains(used, k.key) AND NOT exists(acc, z -> z.f.key = k.key)), 0)))),
                h -> filter(h, y -> y.f IS NOT NULL AND NOT exists(h, z -> z.f.key <=> y.f.key AND z.slot_ix > y.slot_ix)))[0]))
    """
    docs = docs.withColumn("led", F.expr(led)).withColumn("used", F.expr("concat(used, transform(led, z -> z.f.key))"))
    act = """
        transform(transform(m, x -> named_struct('x', x, 'action', CASE WHEN x.key IS NULL THEN 'clear'
                WHEN x.pass = 3 AND (array_contains(used, x.key) OR exists(m, y -> y.pass = 3 AND y.key = x.key AND y.slot_ix < x.slot_ix)) THEN 'keep' ELSE 'fill' END)),
            h -> named_struct('pass', h.x.pass, 'slot_ix', h.x.slot_ix, 'label', h.x.label, 'key', h.x.key,
                'new_value', CASE h.action WHEN 'fill' THEN h.x.value WHEN 'clear' THEN '' END, 'action', h.action))
    """
    line = """
        transform(transform(flatten(transform(p, x -> x.l)), y -> named_struct('y', y, 'f', get(filter(led, z -> z.slot_ix = y.slot_ix), 0).f)),
            h -> named_struct('pass', 2, 'slot_ix', h.y.slot_ix, 'label', h.y.label, 'key', h.f.key, 'new_value', h.f.value, 'action', if(h.f.key IS NULL, 'keep', 'fill')))
    """
    done = docs.select("doc_id", F.inline(F.concat(F.expr(act), F.expr(line))))
    every = [s.select("slot_ix") for s in (inline, bare, known, lines) if s is not None]
    kind = reduce(DataFrame.unionByName, every).schema["slot_ix"].dataType
    return done.withColumn("slot_ix", F.col("slot_ix").cast(kind))


def unused_fields(filled: DataFrame, fields: DataFrame, pairs_per_row: int = 1) -> DataFrame:
    """Fields with a value that no slot took, placed in new rows of ``pairs_per_row`` label-value pairs."""
    used = filled.where("action = 'fill'").select("doc_id", "key").hint("merge")  # grows with the documents: never broadcast
    left = candidates(fields).where(python_trim(T.filled("value")) != "").join(used, ["doc_id", "key"], "left_anti")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return left.withColumn("_k", k).select("doc_id", "key", "value", (F.col("_k") / pairs_per_row).cast("int").alias("row"), (F.col("_k") % pairs_per_row).cast("int").alias("pair"))


def date_action(fields: DataFrame, slots: DataFrame) -> DataFrame:
    """(doc_id, action): whether a template's date label must change: retest_to_expiry, expiry_to_retest, rename_source or none."""
    f = fields.where(python_trim(T.filled("value")) != "").withColumn("n", T.normalize("label")).groupBy("doc_id").agg(F.bool_or(T.expiry_label("n")).alias("s_exp"), F.bool_or(T.retest_label("n")).alias("s_re"))
    t = slots.withColumn("n", T.normalize("label")).groupBy("doc_id").agg(F.bool_or(T.expiry_label("n")).alias("t_exp"), F.bool_or(T.retest_label("n")).alias("t_re"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    action = F.when(no("s_exp") & ~no("s_re") & ~no("t_exp"), "retest_to_expiry").when(~no("s_exp") & no("s_re") & no("t_re"), "rename_source").when(~no("s_exp") & no("s_re"), "expiry_to_retest").otherwise("none")
    return f.join(t, "doc_id", "full_outer").select("doc_id", action.alias("action"))


def results_table(cells: DataFrame) -> DataFrame:
    """(doc_id, table_ix, row_ix, n_roles): the header row of each document's results table, the first with most roles."""
    roles = cells.withColumn("role", T.header_role("text")).where("role IS NOT NULL")
    scored = roles.groupBy("doc_id", "table_ix", "row_ix").agg(F.countDistinct("role").alias("n_roles"), F.bool_or(F.col("role") == "result").alias("_a"), F.bool_or(F.col("role") == "parameter").alias("_b")).where("_a AND _b")
    w = Window.partitionBy("doc_id").orderBy(F.desc("n_roles"), "table_ix", "row_ix")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("doc_id", "table_ix", "row_ix", "n_roles")


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Rows or results (parameter, specification) with ``key`` and ``param_key``."""
    spec = F.substring(T.filled("specification"), 1, 80)
    return rows.withColumn("key", T.normalize(T.canonical_phrases(F.concat(T.filled("parameter"), F.lit(" "), spec)))).withColumn("param_key", T.normalize(T.canonical_phrases(T.filled("parameter"))))


def row_groups(rows: DataFrame) -> DataFrame:
    """Rows of runs of at least two neighbours with one label, with ``group_ix`` and ``rank`` in the run."""
    doc = Window.partitionBy("doc_id").orderBy("row_ix")
    new = F.coalesce((F.col("param_key") != F.lag("param_key").over(doc)).cast("int"), F.lit(1))
    marked = keyed_rows(rows).withColumn("_new", new).withColumn("_run", F.sum("_new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "_run")
    kept = marked.withColumn("_n", F.count("*").over(run)).where("_n >= 2 AND param_key <> ''")
    return kept.withColumn("group_ix", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_run"))).withColumn("rank", F.row_number().over(run.orderBy("row_ix"))).drop("_new", "_run", "_n")


def align_groups(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, group_ix, rank, row_ix, item_ix, action): the k-th row of a group takes its k-th item.

    An item belongs to the first group whose label its own holds; further rows are deleted, further items appended after
    the group's last row. Groups without any item aren't here: they are matched by likeness.
    """
    groups = row_groups(rows)
    heads = groups.groupBy("doc_id", "group_ix").agg(F.first("param_key").alias("group_key"), F.max("row_ix").alias("last_row"))
    mine = keyed_rows(items).select("doc_id", "item_ix", F.col("param_key").alias("item_key")).join(heads, "doc_id").where(T.holds_run("group_key", "item_key"))
    first = mine.groupBy("doc_id", "item_ix").agg(F.min("group_ix").alias("group_ix"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "group_ix").orderBy("item_ix")))
    live = ranked.select("doc_id", "group_ix").distinct()
    left = groups.join(live, ["doc_id", "group_ix"], "left_semi").select("doc_id", "group_ix", "rank", "row_ix")
    both = left.join(ranked, ["doc_id", "group_ix", "rank"], "full_outer")
    action = F.when(F.col("item_ix").isNull(), "delete").when(F.col("row_ix").isNull(), "append").otherwise("update")
    return both.withColumn("action", action).join(heads.select("doc_id", "group_ix", "last_row"), ["doc_id", "group_ix"]).select("doc_id", "group_ix", "rank", "row_ix", "item_ix", "action", F.coalesce("row_ix", "last_row").alias("anchor_ix"))


def assign_rows(rows: DataFrame, items: DataFrame, cutoff: float = ROW_CUTOFF) -> DataFrame:
    """(doc_id, row_ix, item_ix, score): template rows and results, one to one, best scores first; ties by row, then item.

    The choice depends on all earlier ones of a document, hence one fold a document over its scored pairs.
    """
    r = keyed_rows(rows).select("doc_id", "row_ix", F.col("key").alias("rk"), F.col("param_key").alias("rp"))
    i = keyed_rows(items).select("doc_id", "item_ix", F.col("key").alias("ik"), F.col("param_key").alias("ip"))
    score = F.greatest(ratio("rk", "ik"), ratio("rp", "ip"), T.containment("rk", "ip"), T.leading("rp", "ip"))
    scored = r.join(i, "doc_id").select("doc_id", "row_ix", "item_ix", score.alias("score")).where(F.col("score") >= cutoff)

    best_first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("row_ix").cast("bigint").alias("r"), F.col("item_ix").cast("bigint").alias("i"))))
    taken = F.expr("aggregate(p, cast(array() as array<struct<s: double, r: bigint, i: bigint>>), (acc, x) -> if(exists(acc, y -> y.r = x.r OR y.i = x.i), acc, concat(acc, array(x))))")
    folded = scored.groupBy("doc_id").agg(best_first.alias("p")).select("doc_id", F.inline(taken))
    return folded.select("doc_id", F.col("r").cast("int").alias("row_ix"), F.col("i").cast("int").alias("item_ix"), (-F.col("s")).alias("score"))


def row_actions(rows: DataFrame, items: DataFrame, assigned: DataFrame) -> DataFrame:
    """(doc_id, row_ix, item_ix, action, anchor_ix, result): matched rows, rows to delete and items to append after the last row.

    ``result`` is the item's result text, '' if it has none and for rows to delete, null where items come without results.
    """
    matched = assigned.select("doc_id", "row_ix", "item_ix", F.lit("match").alias("action"), F.col("row_ix").alias("anchor_ix"))
    gone = rows.select("doc_id", "row_ix").join(assigned, ["doc_id", "row_ix"], "left_anti").select("doc_id", "row_ix", F.lit(None).cast("bigint").alias("item_ix"), F.lit("delete").alias("action"), F.col("row_ix").alias("anchor_ix"))
    last = rows.groupBy("doc_id").agg(F.max("row_ix").alias("anchor_ix"))
    new = items.select("doc_id", "item_ix").join(assigned, ["doc_id", "item_ix"], "left_anti").join(last, "doc_id").select("doc_id", F.lit(None).cast("bigint").alias("row_ix"), "item_ix", F.lit("append").alias("action"), "anchor_ix")
    long = lambda d: d.select("doc_id", F.col("row_ix").cast("bigint"), F.col("item_ix").cast("bigint"), "action", F.col("anchor_ix").cast("bigint"))
    texts = items.select("doc_id", F.col("item_ix").cast("bigint").alias("item_ix"), (T.filled("result") if "result" in items.columns else F.lit(None).cast("string")).alias("result"))
    every = long(matched).unionByName(long(gone)).unionByName(long(new))
    return every.join(texts, ["doc_id", "item_ix"], "left").select("doc_id", "row_ix", "item_ix", "action", "anchor_ix", F.when(F.col("item_ix").isNull(), "").otherwise(F.col("result")).alias("result"))


def row_texts(rows: DataFrame, items: DataFrame, actions: DataFrame) -> DataFrame:
    """(doc_id, row_ix, item_ix, action, specification, result) of rows after filling.

    A matched row takes the item's specification, be it empty, and its result, unless that is empty: then the old one
    stays. An appended row has the item's texts. ``rows`` have specification and, at times, result.
    """
    old = rows.select("doc_id", F.col("row_ix").cast("bigint").alias("row_ix"), (T.filled("result") if "result" in rows.columns else F.lit("")).alias("_old"))
    new = items.select("doc_id", F.col("item_ix").cast("bigint").alias("item_ix"), T.filled("specification").alias("specification"))
    live = actions.where("action <> 'delete'").join(new, ["doc_id", "item_ix"]).join(old, ["doc_id", "row_ix"], "left")
    return live.select("doc_id", "row_ix", "item_ix", "action", "specification", F.when(F.col("result") != "", F.col("result")).otherwise(T.filled("_old")).alias("result"))


def label_counts(rows: DataFrame) -> DataFrame:
    """Rows with ``n_label``, how many rows of their document have their label."""
    return keyed_rows(rows).withColumn("n_label", F.count("*").over(Window.partitionBy("doc_id", "param_key")))


def grown_rows(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, row_ix, rank, item_ix): rows that grow in place, before any scoring.

    A row grows if its label is the only one of its kind and two items at least hold it: the first item takes the row, the
    others new ones after it, in the items' order. An item that several rows could take goes to the first of them.
    """
    single = label_counts(rows).where("n_label = 1 AND param_key <> ''").select("doc_id", "row_ix", F.col("param_key").alias("_label"))
    held = keyed_rows(items).select("doc_id", "item_ix", F.col("param_key").alias("_item")).join(single, "doc_id").where(T.holds_run("_label", "_item"))
    first = held.groupBy("doc_id", "item_ix").agg(F.min("row_ix").alias("row_ix"))
    row = Window.partitionBy("doc_id", "row_ix")
    many = first.withColumn("_n", F.count("*").over(row)).where("_n >= 2")
    return many.select("doc_id", "row_ix", F.row_number().over(row.orderBy("item_ix")).alias("rank"), "item_ix")


def fill_report(actions: DataFrame) -> DataFrame:
    """Counters of a document's actions; a match with an empty result leaves the row as it was and isn't counted."""
    return actions.groupBy("doc_id").agg(F.count_if((F.col("action") == "match") & (F.coalesce("result", F.lit("?")) != "")).alias("matched"), F.count_if(F.col("action") == "append").alias("appended"), F.count_if(F.col("action") == "delete").alias("deleted"))


def titled_runs(items: DataFrame) -> DataFrame:
    """(doc_id, item_ix, title): consecutive items under the leading words they share (two at least, which may shrink).

    The shared words shrink as a run grows, so it is a fold over each document's items.
    """

    @F.pandas_udf(ArrayType(StringType()))
    def runs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_titles([(p or "").split() for p in parameters]) for parameters in batch])

    ordered = F.array_sort(F.collect_list(F.struct(F.col("item_ix").cast("bigint").alias("item_ix"), "parameter")))
    docs = items.groupBy("doc_id").agg(ordered.alias("_i"))
    titled = docs.withColumn("_t", runs(F.transform("_i", lambda x: x["parameter"])))
    return titled.select("doc_id", F.inline(F.arrays_zip(F.transform("_i", lambda x: x["item_ix"]).alias("item_ix"), F.col("_t").alias("title"))))


def _titles(rows: list[list[str]]) -> list[str | None]:
    out: list[str | None] = []
    while len(out) < len(rows):
        at = len(out)
        shared, end = rows[at], at + 1
        while end < len(rows):
            k = 0
            while k < min(len(shared), len(rows[end])) and shared[k].lower() == rows[end][k].lower():
                k += 1
            if k < 2:
                break
            shared, end = shared[:k], end + 1
        out += [" ".join(shared) if end - at > 1 else None] * (end - at)
    return out


def adjacent_values(cells: DataFrame) -> DataFrame:
    """Cells with the text to the right, right again, and below (same column of the next row)."""
    row = Window.partitionBy("doc_id", "table_ix", "row_ix").orderBy("cell_ix")
    column = Window.partitionBy("doc_id", "table_ix", "cell_ix").orderBy("row_ix")
    below = F.when(F.lead("row_ix").over(column) == F.col("row_ix") + 1, F.lead("text").over(column))
    return cells.withColumn("right", F.lead("text").over(row)).withColumn("right2", F.lead("text", 2).over(row)).withColumn("below", below)


def continued(lines: DataFrame) -> DataFrame:
    """Lines with the last known label at or above them: continuation lines belong to it."""
    w = Window.partitionBy("doc_id").orderBy("line_ix").rowsBetween(Window.unboundedPreceding, 0)
    label = F.regexp_extract("text", f"^\\s*({T.KNOWN_LABEL})", 1)
    return lines.withColumn("label", F.last(F.nullif(label, F.lit("")), ignorenulls=True).over(w))


def signature_action(paragraphs: DataFrame, pictures: DataFrame, signatures: DataFrame) -> DataFrame:
    """(doc_id, action): replace or append at a signature's label, replace the last picture that is no logo, or nothing."""
    anchor = paragraphs.where(T.signature_label("text")).groupBy("doc_id").agg(F.min("para_ix").alias("anchor"))
    pics = pictures.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.when(~F.col("is_logo"), F.col("picture_ix"))).alias("last"))
    near = pictures.join(anchor, "doc_id").where(F.abs(F.col("para_ix") - F.col("anchor")) <= 3).select("doc_id").distinct().withColumn("near", F.lit(True))
    s = signatures.select("doc_id", "present").join(anchor, "doc_id", "left").join(pics, "doc_id", "left").join(near, "doc_id", "left")
    action = F.when(~F.coalesce("present", F.lit(False)), "no_signature_detected").when(F.col("anchor").isNotNull(), F.when(F.col("near"), "replaced_at_anchor").otherwise("appended_at_anchor")).when((F.col("n") >= 2) & F.col("last").isNotNull(), "replaced_last_picture").otherwise("no_anchor_found")
    return s.select("doc_id", action.alias("action"))
