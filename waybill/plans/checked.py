"""Queries of single operators over whole tables, each with its SQL, so that every one is compared by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import geometry as G
from waybill.functions import numbers as N
from waybill.functions import text as T
from waybill.operators import forms, keyed, layout, matching, pictures, rollup
from waybill.plans.reference import _FIELDS, _KNOWN, _NORM, _ORDERS, _SYN, _TRIM, ITEMS_SQL, SLOTS, TEMPLATE_ROWS, WORDS_SQL, _coa, _fields, _orders, _results, _rows, _shipments, _words
from waybill.session import read_table
from waybill.sources import documents as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def checked(sql: str):
    def add(query):
        QUERIES[query.__name__] = query
        ORACLE[query.__name__] = sql
        return query

    return add


_RESULTS = "c AS (SELECT DISTINCT ON (coa_id) * FROM coa_records), r AS (SELECT coa_id AS doc_id, (ix - 1)::INT AS item_ix, coalesce(test_results[ix].parameter, '') AS parameter, coalesce(test_results[ix].specification, '') AS specification, coalesce(test_results[ix].result, '') AS result FROM c, unnest(generate_series(1, len(test_results))) t(ix) WHERE test_results[ix] IS NOT NULL)"
_PHRASED = "regexp_replace(" * len(T.TEST_PHRASES) + "{0}" + "".join(f", '{p}', 'single impurity', 'gi')" for p in T.TEST_PHRASES)
_KEY = lambda x: _NORM.format(_PHRASED.format(x))
_SINGLE = lambda x: f"array_to_string(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END), ' ')"
_TEMPLATE = "(VALUES " + ", ".join(f"({i}, '{p}', '{s}')" for i, (p, s) in enumerate(TEMPLATE_ROWS)) + ") q(row_ix, parameter, specification)"
_HOLDS = lambda group, item: f"({group} <> '' AND contains(' ' || {_SINGLE(item)} || ' ', ' ' || {_SINGLE(group)} || ' '))"


# predicates and texts


@checked(f"""WITH {_FIELDS}, n AS (SELECT DISTINCT label, {_NORM.format("label")} AS n FROM f)
    SELECT label, {" OR ".join(f"contains(n, '{w}')" for w in T.SIGNATURE_WORDS)} AS is_signature FROM n""")
def ref_signature_labels(spark, d):
    return _fields(spark, d).select("label").distinct().select("label", T.signature_label("label").alias("is_signature"))


@checked(f"""WITH {_FIELDS}, n AS (SELECT DISTINCT {_NORM.format("label")} AS n FROM f), p AS (SELECT n AS a, regexp_replace(n, '\\b(test|qualification|evaluation)\\b', 're\\1') AS b FROM n),
    z AS (SELECT a, b, list_filter(string_split(a, ' '), lambda w: w <> '') AS x, list_filter(string_split(b, ' '), lambda w: w <> '') AS y FROM p),
    w AS (SELECT a, b, list_transform(generate_series(1, len(x)), lambda i: CASE WHEN x[i] = y[i] THEN 0 WHEN x[i] = 're' || y[i] OR y[i] = 're' || x[i] THEN 1 ELSE 2 END) AS k FROM z WHERE len(x) = len(y))
    SELECT p.a, p.b, coalesce(NOT list_contains(k, 2) AND list_contains(k, 1), false) AS differs FROM p LEFT JOIN w ON p.a = w.a AND p.b = w.b""")
def ref_re_labels(spark, d):
    n = _fields(spark, d).select(T.normalize("label").alias("a")).distinct()
    return n.withColumn("b", F.regexp_replace("a", r"\b(test|qualification|evaluation)\b", "re$1")).select("a", "b", T.differs_by_re("a", "b").alias("differs"))


@checked(f"""WITH {_RESULTS}, t AS (SELECT doc_id, item_ix, {_TRIM.format("parameter")} AS p, {_TRIM.format("specification")} AS s FROM r)
    SELECT doc_id, item_ix, concat_ws(' ', nullif(p, ''), nullif(s, '')) AS shown FROM t""")
def ref_display_texts(spark, d):
    return _results(spark, d).select("doc_id", "item_ix", T.named("parameter", "specification").alias("shown"))


@checked(f"""WITH {_ORDERS} SELECT po_id, rpad(coalesce(product_name, ''), greatest(length(coalesce(product_name, '')), 24)::INT, ' ') AS padded FROM o""")
def ref_padded_names(spark, d):
    return _orders(spark, d).select("po_id", T.padded("product_name", 24).alias("padded"))


@checked(f"""WITH {ITEMS_SQL} SELECT shipment_id, item_ix, coalesce(try_cast(regexp_replace(coalesce(item.quantity_text, ''), '[^0-9.\\-]', '', 'g') AS DOUBLE), 0) AS n FROM k""")
def ref_cleaned_numbers(spark, d):
    return rollup.shipment_items(_shipments(spark, d)).where("real").select("shipment_id", "item_ix", N.cleaned_number("quantity_text").alias("n"))


@checked(f"""WITH {_FIELDS} SELECT doc_id, field_ix, CASE WHEN length(label) // 2 > 1 THEN left(label, 1) || '<' || length(label) || '>' || substring(label, length(label) // 2 + 1) ELSE label END AS spliced FROM f""")
def ref_spliced_labels(spark, d):
    f = _fields(spark, d)
    return f.select("doc_id", "field_ix", T.splice("label", F.lit(1), F.floor(F.length("label") / 2).cast("int"), F.concat(F.lit("<"), F.length("label").cast("string"), F.lit(">"))).alias("spliced"))


@checked(f"""WITH {_FIELDS} SELECT doc_id, field_ix, regexp_replace(label || ' : old value', '(:\\s*).*$', '\\1new $5 of the row') AS replaced FROM f WHERE NOT regexp_matches(label, '[:\\n]')""")
def ref_replaced_tails(spark, d):
    f = _fields(spark, d).where(~F.col("label").rlike(r"[:\n]"))
    return f.select("doc_id", "field_ix", T.replace_tail(F.concat("label", F.lit(" : old value")), r":\s*", F.lit("new $5 of the row")).alias("replaced"))


_EXP = T.EXPIRY_LABEL
_EXP_UP = T._upper(_EXP)


@checked(f"""WITH {_FIELDS}, l AS (SELECT DISTINCT label FROM f), t AS (SELECT label, label || ': 2024-05' AS t FROM l)
    SELECT label, regexp_replace(regexp_replace(t, '(?:{_EXP_UP})(\\s*[:：])', 'RETEST DATE\\1', 'g'), '(?i)(?:{_EXP})(\\s*[:：])', 'Retest Date\\1', 'g') AS relabelled FROM t""")
def ref_relabelled(spark, d):
    labels = _fields(spark, d).select("label").distinct()
    return labels.select("label", T.relabel(F.concat("label", F.lit(": 2024-05")), T.EXPIRY_LABEL, "Retest Date").alias("relabelled"))


@checked(f"""WITH {_RESULTS}, p AS (SELECT DISTINCT parameter FROM r), x AS (SELECT parameter, {_TRIM.format(r"regexp_replace(parameter, '(?i)^\s*Related Substances?(?:\s*\([^)]*\))?\s*[-:]?\s*', '')")} AS x FROM p)
    SELECT parameter, CASE WHEN x = '' THEN parameter ELSE x END AS own FROM x""")
def ref_own_names(spark, d):
    return _results(spark, d).select("parameter").distinct().select("parameter", T.without_group("parameter", F.lit("Related Substances")).alias("own"))


@checked(f"""WITH {_RESULTS}, p AS (SELECT DISTINCT {_KEY("parameter || ' ' || left(specification, 80)")} AS ik, {_KEY("parameter")} AS ip FROM r), q AS (SELECT DISTINCT {_KEY("parameter || ' ' || left(specification, 80)")} AS rk, {_KEY("parameter")} AS rp FROM {_TEMPLATE}),
    z AS (SELECT rk, rp, ip, CASE WHEN length(rk) <= length(ip) THEN rk ELSE ip END AS s, CASE WHEN length(rk) <= length(ip) THEN ip ELSE rk END AS l FROM q, (SELECT DISTINCT ip FROM p))
    SELECT rk, rp, ip, CASE WHEN length(s) >= 3 AND length(l) <= 60 AND contains(' ' || l || ' ', ' ' || s || ' ') THEN 0.92::DOUBLE ELSE 0.0 END AS containment,
      CASE WHEN length(rp) >= 3 AND starts_with(ip || ' ', rp || ' ') THEN 0.9::DOUBLE ELSE 0.0 END AS leading, {_HOLDS("rp", "ip")} AS holds FROM z""")
def ref_key_scores(spark, d):
    """Every distinct result label against the template's eight rows, a fixed list."""
    labels = matching.keyed_rows(_results(spark, d)).select(F.col("param_key").alias("ip")).distinct()
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.lit(s).alias("specification")) for p, s in TEMPLATE_ROWS])).alias("r")
    pairs = matching.keyed_rows(labels.select("ip", rows).select("ip", "r.*")).select("ip", F.col("key").alias("rk"), F.col("param_key").alias("rp")).distinct()
    return pairs.select("rk", "rp", "ip", T.containment("rk", "ip").alias("containment"), T.leading("rp", "ip").alias("leading"), T.holds_run("rp", "ip").alias("holds"))


@checked(f"""WITH {_FIELDS}, l AS (SELECT DISTINCT label, list_distinct(list_filter(string_split({_NORM.format("label")}, ' '), lambda w: w <> '')) AS x FROM f), s AS (SELECT slot, list_distinct(string_split({_NORM.format("slot")}, ' ')) AS y FROM (VALUES {", ".join(f"('{s}')" for s in SLOTS)}) v(slot))
    SELECT label, slot, len(list_intersect(x, y))::INT AS n_common, len(list_filter(x, lambda w: NOT list_contains(y, w)))::INT AS n_left FROM l, s WHERE len(list_intersect(x, y)) > 0""")
def ref_word_sets(spark, d):
    """Words of labels and of the template's ten slots, a fixed list."""
    x, y = F.array_distinct(T.words(T.normalize("label"))), F.array_distinct(T.words(T.normalize("slot")))
    pairs = _fields(spark, d).select("label").distinct().select("label", F.explode(F.array(*[F.lit(s) for s in SLOTS])).alias("slot"))
    return pairs.where(F.arrays_overlap(x, y)).select("label", "slot", F.size(F.array_intersect(x, y)).alias("n_common"), F.size(F.array_except(x, y)).alias("n_left"))


@checked(r"""WITH v AS (SELECT doc_id, filename, lower(regexp_extract(filename, '\.([^./\\]+)$', 1)) AS e FROM documents)
    SELECT doc_id, CASE WHEN e IN ('pdf', 'docx') THEN e WHEN e IN ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'webp', 'tif', 'tiff') THEN 'image' END AS kind, NOT regexp_matches(filename, '[/\\]') AND regexp_matches(filename, '\.(docx|xlsx)$') AS download_ok FROM v""")
def ref_kinds(spark, d):
    return read_table(spark, d, "documents").select("doc_id", D.kind_of(F.col("filename")).alias("kind"), D.download_name_ok(F.col("filename")).alias("download_ok"))


@checked(r"""SELECT doc_id, md5('data:' || CASE lower(regexp_extract(filename, '\.([^.]+)$', 1)) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'bmp' THEN 'image/bmp' WHEN 'webp' THEN 'image/webp' WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' ELSE 'image/png' END || ';base64,' || base64(encode(text))) AS url_hash FROM documents WHERE text IS NOT NULL AND filename IS NOT NULL""")
def ref_data_urls(spark, d):
    docs = read_table(spark, d, "documents").where("text IS NOT NULL AND filename IS NOT NULL")
    return docs.select("doc_id", F.md5(T.data_url(F.encode("text", "utf-8"), "filename")).alias("url_hash"))


@checked(r"""SELECT doc_id, md5(CASE WHEN coalesce(text, '') = '' THEN 'No text layer; read the images.' WHEN NOT coalesce(text_reliable, false) THEN 'The text layer is unreliable; read the images.' || chr(10) || text ELSE text END) AS prompt_hash FROM documents""")
def ref_prompts(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.md5(D.prompt()).alias("prompt_hash"))


@checked("""WITH c AS (SELECT DISTINCT ON (coa_id) * FROM coa_records), s AS (SELECT coa_id, list_filter(list_transform(list_filter(header_fields, lambda x: x IS NOT NULL), lambda x: {'label': coalesce(x.label, ''), 'value': coalesce(x.value, '')}), lambda x: x.label <> '') AS h FROM c)
    SELECT coa_id, ix - 1 AS k, h[ix].label AS label, h[ix].value AS value FROM s, unnest(generate_series(1, len(h))) t(ix)""")
def ref_sanitised_fields(spark, d):
    s = _coa(spark, d).select("coa_id", F.posexplode(T.sanitised(F.col("header_fields"), ("label", "value"))).alias("k", "f"))
    return s.select("coa_id", F.col("k").cast("long").alias("k"), "f.label", "f.value")


@checked(f"""WITH {_FIELDS} SELECT doc_id, field_ix, length(label) BETWEEN 1 AND 60 AND value <> '' AS ok, regexp_extract(value, '^\\s*[:：]\\s*', 0) AS prefix, substring(value, length(regexp_extract(value, '^\\s*[:：]\\s*', 0)) + 1) AS rest FROM f""")
def ref_value_spans(spark, d):
    p = T.value_prefix("value")
    return _fields(spark, d).select("doc_id", "field_ix", T.valid_span("label", "value").alias("ok"), p["prefix"].alias("prefix"), p["rest"].alias("rest"))


@checked(rf"""WITH {_ORDERS}, t AS (SELECT po_id, {_TRIM.format("coalesce(description_full, '')")} AS t FROM o), u AS (SELECT po_id, t, regexp_extract(t, '^([^\n]*?\b(?:{T.PHARMACOPOEIAS}))(?:[^\w]|$)', 1) AS u FROM t)
    SELECT po_id, CASE WHEN u <> '' THEN u ELSE {_TRIM.format(r"regexp_extract(t, '^([^,(\n]*)', 1)")} END AS product FROM u""")
def ref_product_names(spark, d):
    return _orders(spark, d).select("po_id", T.product_name("description_full").alias("product"))


@checked(r"""WITH v AS (SELECT id, full_text AS t FROM customers) SELECT id, CASE WHEN contains(coalesce(t, ''), chr(10)) THEN string_split(t, chr(10))[1] || chr(10) || 'new' WHEN contains(coalesce(t, ''), ':') THEN regexp_extract(t, '^((?s:.*)):', 1) || ':  new' ELSE 'new' END AS replaced FROM v""")
def ref_second_lines(spark, d):
    return read_table(spark, d, "customers").select("id", T.second_line("full_text", F.lit("new")).alias("replaced"))


@checked(rf"""WITH l AS (SELECT id, list_filter(list_transform(string_split(full_text, chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS l FROM customers WHERE full_text IS NOT NULL) SELECT id, array_to_string(list_resize(l, 2, ''), '|') AS block FROM l""")
def ref_dropped_lines(spark, d):
    c = read_table(spark, d, "customers").where("full_text IS NOT NULL")
    return c.select("id", F.array_join(T.fitted(T.text_lines("full_text"), 2, "drop"), "|").alias("block"))


@checked(r"SELECT vendor_id, regexp_replace(lower(vendor_name), '\s+', '', 'g') IN ('abc', 'generic') AS keeps FROM vendors")
def ref_stamp_exemptions(spark, d):
    return read_table(spark, d, "vendors").select("vendor_id", pictures.keeps_own_stamp(F.col("vendor_name"), ["A B C", "Generic"]).alias("keeps"))


# matching


_CAND = f"{_FIELDS}, k AS (SELECT doc_id, {_NORM.format('label')} AS key, min(field_ix) AS ord, arg_max(value, field_ix) AS value FROM f GROUP BY 1, 2)"
_CANON = lambda x: f"list_sort(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> '' AND w NOT IN ('of', 'the', 'a', 'an')), lambda w: {_SYN}))"


@checked(f"""WITH {_CAND}, kp AS (SELECT *, {_CANON("key")} AS kc, list_distinct(list_filter(string_split(key, ' '), lambda w: w <> '')) AS kw FROM k),
    q AS (SELECT slot_ix, label, {_NORM.format("label")} AS query FROM (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(SLOTS))}) v(slot_ix, label)), qp AS (SELECT *, {_CANON("query")} AS qc, list_distinct(string_split(query, ' ')) AS qw FROM q),
    p AS (SELECT doc_id, slot_ix, query, key, ord, value, qc = kc AND len(qc) > 0 AS e1, len(qc) > 0 AND len(kc) > 0 AND (len(list_filter(qc, lambda w: NOT list_contains(kc, w))) = 0 OR len(list_filter(kc, lambda w: NOT list_contains(qc, w))) = 0) AS e2,
          CASE WHEN len(kw) > 0 THEN len(list_intersect(qw, kw)) / least(len(qw), len(kw))::DOUBLE ELSE 0 END AS s4, list_contains(qc, 'qty') AND list_contains(kc, 'qty') AS q5, list_has_any(kc, {list(T.MOLECULAR)}) AS m5 FROM qp, kp),
    n AS (SELECT *, count(*) FILTER (e2) OVER w AS n2, count(*) FILTER (q5 AND NOT m5) OVER w AS n5, count(*) FILTER (q5) OVER w AS nq FROM p WINDOW w AS (PARTITION BY doc_id, slot_ix)),
    t AS (SELECT *, CASE WHEN query = key THEN 0 WHEN e1 THEN 1 WHEN e2 AND n2 = 1 THEN 2 WHEN s4 >= 0.8 THEN 4 WHEN q5 AND ((NOT m5 AND n5 = 1) OR (n5 = 0 AND nq = 1)) THEN 5 END AS tier FROM n),
    b AS (SELECT * FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, slot_ix ORDER BY tier, CASE WHEN tier = 4 THEN -s4 ELSE 0 END, ord) = 1)
    SELECT doc_id, slot_ix, key, value, tier FROM b""")
def ref_exact_matches(spark, d):
    """The tiers of label matching without the one by spelling."""
    fields = _fields(spark, d)
    slots = fields.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(*[F.lit(x) for x in SLOTS])).alias("slot_ix", "label"))
    return matching.best_matches(slots, fields, cutoff=2.0).where("tier IS NOT NULL").select("doc_id", "slot_ix", "key", "value", "tier")


@checked(f"""WITH {_CAND}, u AS (SELECT doc_id, key, value, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS k FROM k WHERE {_TRIM.format("coalesce(value, '')")} <> '' AND key NOT IN ({", ".join(f"'{' '.join(''.join(c if c.isalnum() else ' ' for c in s.lower()).split())}'" for s in SLOTS)}))
    SELECT doc_id, key, value, (k // 2)::INT AS row, (k % 2)::INT AS pair FROM u""")
def ref_appended_fields(spark, d):
    """Fields whose label no slot has, placed in new rows of two pairs."""
    fields = _fields(spark, d)
    filled = fields.select("doc_id", T.normalize("label").alias("key"), F.lit("fill").alias("action")).where(F.col("key").isin([" ".join("".join(c if c.isalnum() else " " for c in s.lower()).split()) for s in SLOTS]))
    return matching.unused_fields(filled, fields, 2)


_EXACT = f"""{_RESULTS}, i AS (SELECT doc_id, item_ix, specification, result, {_KEY("parameter")} AS pk FROM r), ik AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pk ORDER BY item_ix) AS k FROM i),
    t AS (SELECT doc_id, row_ix, {_KEY("parameter")} AS pk FROM (SELECT DISTINCT doc_id FROM r), {_TEMPLATE}), tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pk ORDER BY row_ix) AS k FROM t),
    m AS (SELECT tk.doc_id, tk.row_ix, ik.item_ix FROM tk JOIN ik ON tk.doc_id = ik.doc_id AND tk.pk = ik.pk AND tk.k = ik.k),
    a AS (SELECT doc_id, row_ix, item_ix, 'match' AS action, row_ix AS anchor_ix FROM m UNION ALL SELECT doc_id, row_ix, NULL, 'delete', row_ix FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = t.doc_id AND m.row_ix = t.row_ix)
          UNION ALL SELECT doc_id, NULL, item_ix, 'append', {len(TEMPLATE_ROWS) - 1} FROM i WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = i.doc_id AND m.item_ix = i.item_ix)),
    z AS (SELECT a.doc_id, row_ix::BIGINT AS row_ix, a.item_ix::BIGINT AS item_ix, action, anchor_ix::BIGINT AS anchor_ix, coalesce(i.result, '') AS result, coalesce(i.specification, '') AS specification FROM a LEFT JOIN i ON a.doc_id = i.doc_id AND a.item_ix = i.item_ix)"""


def _exact_actions(spark, d):
    from pyspark.sql import Window

    items = _results(spark, d)
    rows = _rows(items)
    k = lambda t, ix: matching.keyed_rows(t).withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "param_key").orderBy(ix))).select("doc_id", "param_key", "_k", ix)
    equal = k(rows, "row_ix").join(k(items, "item_ix"), ["doc_id", "param_key", "_k"]).select("doc_id", "row_ix", "item_ix")
    return rows, items, matching.row_actions(rows, items, equal)


@checked(f"WITH {_EXACT} SELECT doc_id, row_ix, item_ix, action, anchor_ix, result FROM z")
def ref_exact_row_actions(spark, d):
    """The actions on a template's rows where equal labels are matched in order."""
    return _exact_actions(spark, d)[2]


@checked(f"WITH {_EXACT} SELECT doc_id, count(*) FILTER (action = 'match' AND result <> '') AS matched, count(*) FILTER (action = 'append') AS appended, count(*) FILTER (action = 'delete') AS deleted FROM z GROUP BY doc_id")
def ref_fill_counts(spark, d):
    return matching.fill_report(_exact_actions(spark, d)[2])


@checked(f"WITH {_EXACT} SELECT doc_id, row_ix, item_ix, action, specification, result FROM z WHERE action <> 'delete'")
def ref_filled_rows(spark, d):
    return matching.row_texts(*_exact_actions(spark, d))


@checked(f"""WITH {_RESULTS}, i AS (SELECT doc_id, item_ix, {_KEY("parameter")} AS ik FROM r), g AS (SELECT doc_id, item_ix, row_number() OVER (PARTITION BY doc_id ORDER BY item_ix) AS rank FROM i WHERE {_HOLDS("'related substances'", "ik")}),
    t AS (SELECT DISTINCT g.doc_id, row_ix, row_ix - 1 AS rank FROM g, (VALUES (2), (3)) v(row_ix))
    SELECT coalesce(t.doc_id, g.doc_id) AS doc_id, 1 AS group_ix, coalesce(t.rank, g.rank)::INT AS rank, row_ix, item_ix, CASE WHEN item_ix IS NULL THEN 'delete' WHEN row_ix IS NULL THEN 'append' ELSE 'update' END AS action, coalesce(row_ix, 3) AS anchor_ix
    FROM t FULL JOIN g ON t.doc_id = g.doc_id AND t.rank = g.rank""")
def ref_aligned_groups(spark, d):
    """The template's one run of equal labels, aligned by rank."""
    items = _results(spark, d)
    return matching.align_groups(_rows(items), items)


@checked(f"""WITH {_RESULTS} SELECT doc_id, item_ix, {_KEY("parameter")} AS param_key, count(*) OVER (PARTITION BY doc_id, {_KEY("parameter")}) AS n_label FROM r""")
def ref_label_counts(spark, d):
    return matching.label_counts(_results(spark, d)).select("doc_id", "item_ix", "param_key", "n_label")


@checked(f"""WITH {_RESULTS}, i AS (SELECT doc_id, item_ix, {_KEY("parameter")} AS ik FROM r), s AS (SELECT row_ix, {_KEY("parameter")} AS rk FROM {_TEMPLATE} QUALIFY count(*) OVER (PARTITION BY {_KEY("parameter")}) = 1),
    h AS (SELECT doc_id, item_ix, min(row_ix) AS row_ix FROM i, s WHERE {_HOLDS("rk", "ik")} GROUP BY 1, 2), n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY item_ix) AS rank FROM h WINDOW w AS (PARTITION BY doc_id, row_ix))
    SELECT doc_id, row_ix, rank::INT AS rank, item_ix FROM n WHERE n >= 2""")
def ref_grown_rows(spark, d):
    items = _results(spark, d)
    return matching.grown_rows(_rows(items), items)


# cells of tables


def _cells(spark, d) -> DataFrame:
    """The results of a certificate as a table of four columns with a header, its header fields as one of two."""
    r = _results(spark, d)
    head = r.select("doc_id").distinct().select("doc_id", F.lit(1).alias("table_ix"), F.lit(0).alias("row_ix"), F.posexplode(F.array(*[F.lit(x) for x in ("S. No.", "Tests", "Limits", "Results")])).alias("cell_ix", "text"))
    body = r.select("doc_id", F.lit(1).alias("table_ix"), (F.col("item_ix") + 1).alias("row_ix"), F.posexplode(F.array((F.col("item_ix") + 1).cast("string"), "parameter", "specification", "result")).alias("cell_ix", "text"))
    f = _fields(spark, d).select("doc_id", F.lit(0).alias("table_ix"), F.col("field_ix").alias("row_ix"), F.posexplode(F.array("label", "value")).alias("cell_ix", "text"))
    return f.unionByName(head).unionByName(body)


_CELLS = f"""{_FIELDS}, {_RESULTS.split("), r AS", 1)[1].join(["r AS", ""])}, cells AS (SELECT doc_id, 0 AS table_ix, field_ix AS row_ix, x AS cell_ix, [label, value][x + 1] AS text FROM f, (VALUES (0), (1)) v(x)
    UNION ALL SELECT doc_id, 1, 0, x, ['S. No.', 'Tests', 'Limits', 'Results'][x + 1] FROM (SELECT DISTINCT doc_id FROM r), (VALUES (0), (1), (2), (3)) v(x)
    UNION ALL SELECT doc_id, 1, item_ix + 1, x, [(item_ix + 1)::VARCHAR, parameter, specification, result][x + 1] FROM r, (VALUES (0), (1), (2), (3)) v(x))"""
_ROLE = lambda n: f"CASE {' '.join(f'WHEN {chr(32).join([chr(40)]) + " OR ".join(f"contains({n}, {chr(39)}{k}{chr(39)})" for k in keys) + chr(41)} THEN {chr(39)}{role}{chr(39)}' for role, keys in T.ROLES)} END"


@checked(f"""WITH {_CELLS}, n AS (SELECT *, {_NORM.format("text")} AS n FROM cells), o AS (SELECT doc_id, table_ix, row_ix, {_ROLE("n")} AS role FROM n)
    SELECT doc_id, table_ix, row_ix, n_roles FROM (SELECT doc_id, table_ix, row_ix, count(DISTINCT role) AS n_roles, bool_or(role = 'result') AS a, bool_or(role = 'parameter') AS b FROM o WHERE role IS NOT NULL GROUP BY ALL) WHERE a AND b
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_roles DESC, table_ix, row_ix) = 1""")
def ref_results_tables(spark, d):
    return matching.results_table(_cells(spark, d))


@checked(f"""WITH {_CELLS} SELECT doc_id, table_ix, row_ix, cell_ix, lead(text) OVER r AS "right", lead(text, 2) OVER r AS right2, CASE WHEN lead(row_ix) OVER c = row_ix + 1 THEN lead(text) OVER c END AS below FROM cells
    WINDOW r AS (PARTITION BY doc_id, table_ix, row_ix ORDER BY cell_ix), c AS (PARTITION BY doc_id, table_ix, cell_ix ORDER BY row_ix)""")
def ref_adjacent_cells(spark, d):
    return matching.adjacent_values(_cells(spark, d)).select("doc_id", "table_ix", "row_ix", "cell_ix", "right", "right2", "below")


@checked(f"""WITH {_CELLS}, w AS (SELECT doc_id, table_ix, row_ix, count(*) AS n FROM cells GROUP BY ALL) SELECT doc_id, table_ix, count(*) AS n_rows, max(n) AS n_cols FROM w GROUP BY ALL""")
def ref_table_widths(spark, d):
    return layout.table_width(_cells(spark, d))


@checked(f"""WITH {_CELLS} SELECT doc_id, table_ix, row_ix, cell_ix // 2 AS cell_id, min(cell_ix) AS cell_ix, arg_min(text, cell_ix) AS text FROM cells GROUP BY doc_id, table_ix, row_ix, cell_ix // 2""")
def ref_merged_cells(spark, d):
    """Rows whose cells are merged two by two."""
    return layout.once_per_cell(_cells(spark, d).withColumn("cell_id", F.floor(F.col("cell_ix") / 2).cast("int")))


@checked(rf"""WITH {_FIELDS}, l AS (SELECT doc_id, field_ix, regexp_extract(label || ' ' || value, '^\s*({_KNOWN.removeprefix("(?i)^").removesuffix("$")})(?:[^a-zA-Z0-9]|$)', 1, 'i') AS l FROM f)
    SELECT doc_id, field_ix AS line_ix, last_value(nullif(l, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY field_ix ROWS UNBOUNDED PRECEDING) AS label FROM l""")
def ref_continued_lines(spark, d):
    lines = _fields(spark, d).select("doc_id", F.col("field_ix").alias("line_ix"), F.concat("label", F.lit(" "), "value").alias("text"))
    return matching.continued(lines).select("doc_id", "line_ix", "label")


# pictures and boxes


_BOXED = "c AS (SELECT DISTINCT ON (coa_id) * FROM coa_records), b AS (SELECT coa_id, signature.bbox AS b FROM c WHERE len(signature.bbox) = 4), u AS (SELECT coa_id, list_transform(b, lambda v: greatest(0.0::DOUBLE, least(1.0::DOUBLE, v))) AS b FROM b), s AS (SELECT coa_id, least(b[1], b[3]) AS x0, greatest(b[1], b[3]) AS x1, least(b[2], b[4]) AS y0, greatest(b[2], b[4]) AS y1 FROM u), k AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM s WHERE x1 - x0 >= 0.005 AND y1 - y0 >= 0.005)"


def _signature_boxes(spark, d, *margins: float) -> DataFrame:
    boxed = _coa(spark, d).where("size(signature.bbox) = 4")
    return boxed.select("coa_id", G.clamped_box(*[F.get("signature.bbox", F.lit(i)) for i in range(4)], *margins).alias("box")).where("box IS NOT NULL")


@checked(f"""WITH {_BOXED}, m AS (SELECT coa_id, greatest(0, least(1, x0 - 0.08::DOUBLE * w)) AS x0, greatest(0, least(1, y0 - 0.15::DOUBLE * h)) AS y0, greatest(0, least(1, x1 + 0.08::DOUBLE * w)) AS x1, greatest(0, least(1, y1 + 0.15::DOUBLE * h)) AS y1 FROM k)
    SELECT coa_id, trunc(x0 * 1654)::INT AS x0, trunc(y0 * 2339)::INT AS y0, trunc(x1 * 1654)::INT AS x1, trunc(y1 * 2339)::INT AS y1 FROM m""")
def ref_pixel_boxes(spark, d):
    """The boxes of signatures with their margins, in pixels of a page of 200 dpi."""
    return _signature_boxes(spark, d, 0.08, 0.15).select("coa_id", G.pixel_box(F.col("box"), F.lit(1654), F.lit(2339)).alias("p")).select("coa_id", "p.*")


@checked(f"""WITH {_BOXED}, p AS (SELECT coa_id, w * 595.0::DOUBLE AS w, h * 842.0::DOUBLE AS h FROM k)
    SELECT coa_id, (w * h) / (595.0::DOUBLE * 842.0::DOUBLE) BETWEEN 0.001 AND 0.5 AND NOT (w > 0.97 * 595 AND h > 0.97 * 842) AND least(w, h) >= 15 AND greatest(w, h) <= 12 * least(w, h) AS kept FROM p""")
def ref_ink_regions(spark, d):
    w, h = (F.col("box.x1") - F.col("box.x0")) * 595.0, (F.col("box.y1") - F.col("box.y0")) * 842.0
    return _signature_boxes(spark, d).select("coa_id", G.region_kept(w, h, F.lit(595.0), F.lit(842.0)).alias("kept"))


@checked(f"""WITH {_BOXED}, p AS (SELECT coa_id, (coa_id % 7)::INT AS position, CASE WHEN coa_id % 5 > 0 THEN (coa_id % 5)::INT END AS first_table, w * 8 AS w, h * 8 AS h, coa_id % 3 = 0 AS inline_first, x0 * 8 AS dx, CASE WHEN coa_id % 4 > 0 THEN y0 * 11 - 1 END AS dy FROM k)
    SELECT coa_id, position <= coalesce(first_table, position) AND ((w / h >= 1.8 AND (inline_first OR (coalesce(dx, 9) < 1.5 AND coalesce(dy, 9) < 1.5))) OR coalesce(dy, 0) < 0) AS letterhead FROM p""")
def ref_letterheads(spark, d):
    """Pictures at the boxes of signatures, their places told by the certificates' ids."""
    i, b = F.col("coa_id"), F.col("box")
    first = F.when(i % 5 > 0, (i % 5).cast("int"))
    found = G.letterhead((i % 7).cast("int"), first, (b["x1"] - b["x0"]) * 8, (b["y1"] - b["y0"]) * 8, i % 3 == 0, b["x0"] * 8, F.when(i % 4 > 0, b["y0"] * 11 - 1))
    return _signature_boxes(spark, d).select("coa_id", found.alias("letterhead"))


@checked(f"""WITH {_ORDERS}, p AS (SELECT po_id, quantity AS w, unit_price AS h FROM o WHERE quantity > 0 AND unit_price > 0), s AS (SELECT *, least(300.0::DOUBLE / w, 120.0::DOUBLE / h) AS k FROM p), z AS (SELECT po_id, trunc(w * k)::BIGINT AS width, trunc(h * k)::BIGINT AS height FROM s)
    SELECT po_id, width, height, floor((300 - width) / 2.0)::BIGINT AS dx, floor((120 - height) / 2.0)::BIGINT AS dy FROM z""")
def ref_fitted_pictures(spark, d):
    o = _orders(spark, d).where("quantity > 0 AND unit_price > 0")
    return o.select("po_id", G.fit(F.col("quantity"), F.col("unit_price"), F.lit(300.0), F.lit(120.0)).alias("p")).select("po_id", "p.width", "p.height", F.col("p.dx").cast("long").alias("dx"), F.col("p.dy").cast("long").alias("dy"))


def _pictures(spark, d) -> DataFrame:
    """A picture for each result of a certificate, three to a page, its size told by its texts."""
    return _results(spark, d).select("doc_id", F.floor(F.col("item_ix") / 3).cast("int").alias("page"), F.col("item_ix").alias("picture_ix"), (F.length("parameter") * 4).alias("width"), (F.length("specification") * 3).alias("height"))


_PICTURES = f"{_RESULTS}, p AS (SELECT doc_id, item_ix // 3 AS page, item_ix AS picture_ix, (length(parameter) * 4)::INT AS width, (length(specification) * 3)::INT AS height FROM r)"


@checked(f"""WITH {_PICTURES} SELECT doc_id, page, picture_ix, width, height, CASE WHEN height > 0 THEN width / height::DOUBLE ELSE 0 END AS aspect FROM p WHERE width >= 25 AND height >= 25 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, picture_ix) <= 40""")
def ref_kept_pictures(spark, d):
    return pictures.kept_pictures(_pictures(spark, d)).select("doc_id", "page", "picture_ix", "width", "height", pictures.aspect(F.col("width"), F.col("height")).alias("aspect"))


@checked(f"""WITH {_PICTURES}, g AS (SELECT DISTINCT doc_id, page FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n FROM g) SELECT doc_id, page, n <= {pictures.PAGES} AS rendered FROM n WHERE n <= {pictures.LAYOUT_PAGES}""")
def ref_page_caps(spark, d):
    """The pages of a document that are converted, and those among them that are rendered."""
    pages = _pictures(spark, d).select("doc_id", "page").distinct()
    rendered = pictures.first_of(pages, ["doc_id"], ["page"], pictures.PAGES).withColumn("rendered", F.lit(True))
    kept = pictures.first_of(pages, ["doc_id"], ["page"], pictures.LAYOUT_PAGES)
    return kept.join(rendered, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("rendered", F.lit(False)).alias("rendered"))


@checked(f"""WITH {_FIELDS} SELECT doc_id, field_ix, count(*) OVER (PARTITION BY doc_id, {_NORM.format("label")}) > 1 AS shared FROM f""")
def ref_shared_pictures(spark, d):
    drawings = _fields(spark, d).select("doc_id", "field_ix", T.normalize("label").alias("rel_id"))
    return pictures.shared_pictures(drawings).select("doc_id", "field_ix", "shared")


@checked(f"""WITH {_RESULTS}, m AS (SELECT doc_id, max(item_ix) - 1 AS last FROM r WHERE item_ix > 0 GROUP BY 1), g AS (SELECT doc_id, item_ix // 2 AS drawing_id, min(item_ix) AS row_ix FROM r GROUP BY 1, 2)
    SELECT g.doc_id, drawing_id, least(row_ix, last) AS row_ix FROM g JOIN m ON g.doc_id = m.doc_id""")
def ref_reattached_pictures(spark, d):
    """A drawing in every two rows of results, after the last row was deleted."""
    r = _results(spark, d)
    drawings = r.select("doc_id", F.floor(F.col("item_ix") / 2).cast("int").alias("drawing_id"), F.col("item_ix").alias("row_ix"), F.lit(0).alias("cell_ix"))
    left = r.where("item_ix > 0").select("doc_id", (F.col("item_ix") - 1).alias("row_ix"))
    return pictures.reattached(drawings, left).select("doc_id", "drawing_id", "row_ix")


@checked(f"""WITH {_RESULTS} SELECT doc_id, (coalesce(max(try_cast(regexp_extract(result, '(\\d+)', 1) AS INT)), 0) + 1)::INT AS next FROM r GROUP BY doc_id""")
def ref_next_numbers(spark, d):
    return pictures.next_number(_results(spark, d), "result")


@checked(f"""WITH {_RESULTS}, n AS (SELECT doc_id, item_ix, {_NORM.format("parameter")} AS n FROM r), t AS (SELECT doc_id, item_ix, {_ROLE("n")} AS title FROM n), m AS (SELECT doc_id, item_ix, title, CASE WHEN title IS NULL THEN NULL WHEN title IS DISTINCT FROM lag(title) OVER (PARTITION BY doc_id ORDER BY item_ix) THEN 'restart' ELSE 'continue' END AS merge FROM t)
    SELECT doc_id, item_ix AS row_ix, merge, CASE merge WHEN 'restart' THEN title WHEN 'continue' THEN '' END AS shown FROM m""")
def ref_merged_titles(spark, d):
    rows = _results(spark, d).select("doc_id", F.col("item_ix").alias("row_ix"), T.header_role("parameter").alias("title"))
    return pictures.merged_titles(rows).select("doc_id", "row_ix", "merge", "shown")


@checked(f"""WITH {WORDS_SQL}, p AS (SELECT doc_id, word_ix, (word_ix * 7) % 256 AS r, (word_ix * 11) % 256 AS g, (word_ix * 13) % 256 AS b FROM w) SELECT doc_id, count(*) FILTER (r >= 235 AND g >= 235 AND b >= 235) AS n_clear, count(*) AS n FROM p GROUP BY doc_id""")
def ref_clear_pixels(spark, d):
    """Pixels whose colours are told by the words' places."""
    i = F.col("word_ix")
    alpha = pictures.cleared_background(F.struct((i * 7 % 256).alias("r"), (i * 11 % 256).alias("g"), (i * 13 % 256).alias("b"), F.lit(255).alias("a")))
    return _words(spark, d).groupBy("doc_id").agg(F.count_if(alpha == 0).alias("n_clear"), F.count("*").alias("n"))


_MARKED = f"{_FIELDS}, p AS (SELECT doc_id, field_ix AS para_ix, field_ix AS picture_ix, field_ix % 6 = 1 AS is_logo FROM f WHERE field_ix % 3 = 1), g AS (SELECT doc_id, field_ix AS para_ix FROM f WHERE {' OR '.join(f'contains({_NORM.format("label")}, {chr(39)}{w}{chr(39)})' for w in T.SIGNATURE_WORDS)})"


def _marked(spark, d):
    f = _fields(spark, d)
    pics = f.where("field_ix % 3 = 1").select("doc_id", F.col("field_ix").alias("para_ix"), F.col("field_ix").alias("picture_ix"), (F.col("field_ix") % 6 == 1).alias("is_logo"))
    return f.select("doc_id", F.col("field_ix").alias("para_ix"), F.col("label").alias("text")), pics


@checked(f"""WITH {_MARKED} SELECT g.doc_id, g.para_ix, picture_ix, p.para_ix AS picture_para FROM g JOIN p ON g.doc_id = p.doc_id AND abs(p.para_ix - g.para_ix) <= 3
    QUALIFY row_number() OVER (PARTITION BY g.doc_id, g.para_ix ORDER BY (p.para_ix <> g.para_ix)::INT, p.para_ix, picture_ix) = 1""")
def ref_nearest_pictures(spark, d):
    paragraphs, pics = _marked(spark, d)
    return layout.nearest_picture(paragraphs.where(T.signature_label("text")).select("doc_id", "para_ix"), pics)


@checked(f"""WITH {_MARKED}, a AS (SELECT doc_id, min(para_ix) AS anchor FROM g GROUP BY 1), q AS (SELECT doc_id, count(*) AS n, max(CASE WHEN NOT is_logo THEN picture_ix END) AS last FROM p GROUP BY 1), s AS (SELECT coa_id AS doc_id, coalesce(signature.present, false) AS present FROM c)
    SELECT s.doc_id, CASE WHEN NOT present THEN 'no_signature_detected' WHEN anchor IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.doc_id = s.doc_id AND abs(p.para_ix - anchor) <= 3) THEN 'replaced_at_anchor' ELSE 'appended_at_anchor' END WHEN n >= 2 AND last IS NOT NULL THEN 'replaced_last_picture' ELSE 'no_anchor_found' END AS action
    FROM s LEFT JOIN a ON s.doc_id = a.doc_id LEFT JOIN q ON s.doc_id = q.doc_id""")
def ref_signature_actions(spark, d):
    paragraphs, pics = _marked(spark, d)
    return matching.signature_action(paragraphs, pics, _coa(spark, d).select(F.col("coa_id").alias("doc_id"), F.col("signature.present").alias("present")))


# words of pages


@checked(f"""WITH {WORDS_SQL}, b AS (SELECT DISTINCT doc_id, page, y AS top FROM words, (VALUES (18.0::DOUBLE), (90.0::DOUBLE)) v(y)), u AS (SELECT doc_id, page, top, 'text' AS kind, 0 AS k FROM lines UNION ALL SELECT doc_id, page, top, 'table', 1 FROM b)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, top, k)::INT AS seq, kind, top FROM u""")
def ref_reading_sequence(spark, d):
    words = _words(spark, d)
    lines = layout.lines(words).select("doc_id", "page", "top", F.lit("text").alias("kind"))
    boxes = words.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(F.array(F.lit(18.0), F.lit(90.0))).alias("top"), F.lit("table").alias("kind"))
    return layout.reading_order(lines, boxes).select("doc_id", "seq", "kind", "top")


@checked(f"""WITH {WORDS_SQL}, s AS (SELECT doc_id, (x0)::INT AS x, sum(length(text)) AS v FROM words GROUP BY 1, 2), m AS (SELECT *, max(v) OVER (PARTITION BY doc_id) AS m FROM s), t AS (SELECT doc_id, x FROM m WHERE v > 0.3 * m),
    f AS (SELECT *, CASE WHEN x - lag(x) OVER w > 5 THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY x)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS cluster_ix FROM f)
    SELECT doc_id, cluster_ix::BIGINT AS cluster_ix, trunc(avg(x))::INT AS centre, count(*) AS n FROM g GROUP BY 1, 2""")
def ref_profile_peaks(spark, d):
    """Columns of a page where most letters stand."""
    ink = _words(spark, d).select("doc_id", F.col("x0").cast("int").alias("x"), F.length("text").alias("v"))
    return layout.profile_peaks(ink, ["doc_id"], "x", "v")


@checked(f"""WITH {WORDS_SQL}, p AS (SELECT doc_id, word_ix, {_TRIM.format("text")} AS text, (word_ix * 37) % 100 AS conf, top, bottom FROM words)
    SELECT doc_id, count(*) AS n, round(sum((bottom - top) * 0.8), 3) AS heights, round(min(top), 3) AS first FROM p WHERE text <> '' AND conf >= 40 GROUP BY doc_id""")
def ref_ocr_words(spark, d):
    """Words with a confidence told by their place, in pixels of 72 dpi."""
    raw = _words(spark, d).withColumn("conf", F.col("word_ix") * 37 % 100)
    kept = layout.ocr_words(raw, dpi=72)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("size"), 3).alias("heights"), F.round(F.min("top"), 3).alias("first"))


@checked(f"""WITH {WORDS_SQL}, m AS (SELECT doc_id, list_sort(list(size))[count(*) // 2 + 1] AS median FROM words GROUP BY doc_id)
    SELECT l.doc_id, line_ix::BIGINT AS line_ix, greatest(8, least(round(size, 4) * 3, 36)) AS font, size > median + 2 OR (size > 11 AND size >= median) AS heading, abs((x0 + x1) / 2 - 60) < 0.08 * 120 AND x0 > 0.15 * 120 AS centred FROM lines l JOIN m ON l.doc_id = m.doc_id""")
def ref_block_styles(spark, d):
    words = _words(spark, d)
    lines = layout.lines(words).join(words.groupBy("doc_id").agg(layout.upper_median("size").alias("median")), "doc_id")
    style = layout.block_style(F.round("size", 4) * 3, F.lit(False), F.col("median"))
    heading = layout.block_style(F.col("size"), F.col("size") > 11, F.col("median"))["heading"]
    return lines.select("doc_id", "line_ix", style["font"].alias("font"), heading.alias("heading"), G.is_centred(F.col("x0"), F.col("x1"), F.lit(120.0)).alias("centred"))


# roll-ups, keys and forms


@checked(f"""WITH {ITEMS_SQL}, z AS (SELECT s.shipment_id, k.item_ix, k.item FROM s LEFT JOIN k ON s.shipment_id = k.shipment_id)
    SELECT shipment_id, coalesce(item_ix, 0)::INT AS item_ix, item IS NOT NULL AS real, coalesce(item.material_name, '') AS material_name, coalesce(item.quantity_value, 0) AS quantity_value, coalesce(item.net_weight_text, '') AS net_weight_text FROM z""")
def ref_outer_items(spark, d):
    """Items with the row of blanks of a shipment that has none."""
    return rollup.shipment_items(_shipments(spark, d)).select("shipment_id", "item_ix", "real", "material_name", "quantity_value", "net_weight_text")


@checked(f"""WITH {ITEMS_SQL}, z AS (SELECT s.shipment_id, coalesce(k.item_ix, 0)::INT AS item_ix, k.item FROM s LEFT JOIN k ON s.shipment_id = k.shipment_id), b AS (SELECT shipment_id, item_ix, list_filter(item.batches, lambda x: x IS NOT NULL) AS bs FROM z)
    SELECT shipment_id, item_ix, coalesce(ix - 1, 0)::INT AS batch_ix, coalesce(bs[ix].batch_no, '') AS batch_no, CASE WHEN coalesce(bs[ix].expiry_date, '') <> '' THEN 'Exp. Date: ' || bs[ix].expiry_date WHEN coalesce(bs[ix].retest_date, '') <> '' THEN 'Retest Date: ' || bs[ix].retest_date ELSE 'Exp. Date: ' END AS date
    FROM b, unnest(CASE WHEN len(bs) > 0 THEN generate_series(1, len(bs)) ELSE [NULL::BIGINT] END) t(ix)""")
def ref_outer_batches(spark, d):
    """Batches with their date's label, and the rows of blanks of items without batches and shipments without items."""
    return rollup.item_batches(rollup.shipment_items(_shipments(spark, d))).select("shipment_id", "item_ix", "batch_ix", "batch_no", forms.date_of_batch().alias("date"))


@checked(f"""WITH {_ORDERS} SELECT vendor_id, round(coalesce(sum(coalesce(total_price, 0)::DECIMAL(30, 6)), 0)::DOUBLE, 2) AS total, count(*) AS n FROM o GROUP BY vendor_id""")
def ref_plain_sums(spark, d):
    return _orders(spark, d).groupBy("vendor_id").agg(F.round(rollup.plain_sum(F.col("total_price").cast("decimal(30,6)")).cast("double"), 2).alias("total"), F.count("*").alias("n"))


_NAMES = f"""{_ORDERS}, n AS (SELECT DISTINCT string_split(consignee, chr(10))[1] AS name FROM o WHERE trim(string_split(consignee, chr(10))[1]) <> ''),
    b AS (SELECT name, coalesce(nullif(left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), ''), 'customer') AS base FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY name) AS k FROM b),
    m AS (SELECT base, max(k) AS m FROM k GROUP BY 1), x AS (SELECT base, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS id, i FROM m, unnest(generate_series(1, m + 400)) t(i)),
    y AS (SELECT base, id, row_number() OVER (PARTITION BY base ORDER BY i) AS k FROM x WHERE id NOT IN (SELECT id FROM customers))"""


@checked(f"WITH {_NAMES} SELECT k.name, y.id FROM k JOIN y ON k.base = y.base AND k.k = y.k")
def ref_new_customer_ids(spark, d):
    """Ids for the consignees' names, the free ones of each slug in order."""
    new = _orders(spark, d).select(F.split_part("consignee", F.lit("\n"), F.lit(1)).alias("name")).where("trim(name) <> ''").distinct()
    return keyed.with_ids(new, read_table(spark, d, "customers").select("id")).select("name", "id")


@checked("""SELECT DISTINCT lower(regexp_replace(site_code, '[^A-Za-z]', '', 'g')) || '-' || vendor_id AS id FROM vendors UNION SELECT DISTINCT 'x' || id FROM customers WHERE 'x' || id NOT IN (SELECT id FROM customers)""")
def ref_missing_customers(spark, d):
    """Ids asked for that no customer has."""
    c = read_table(spark, d, "customers").select("id")
    asked = c.unionByName(c.select(F.concat(F.lit("x"), "id").alias("id"))).unionByName(read_table(spark, d, "vendors").select(F.concat(F.lower(F.regexp_replace("site_code", "[^A-Za-z]", "")), F.lit("-"), "vendor_id").alias("id"))).distinct()
    return keyed.missing(c, asked)


@checked(f"""WITH {ITEMS_SQL}, z AS (SELECT DISTINCT coalesce(origin, '') AS origin, coalesce(nullif(k.item.currency, ''), 'USD') AS currency FROM s LEFT JOIN k ON s.shipment_id = k.shipment_id)
    SELECT origin, upper(origin) AS origin_upper, currency, CASE currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' ELSE currency END AS symbol FROM z""")
def ref_origins_and_symbols(spark, d):
    rows = rollup.shipment_items(_shipments(spark, d)).select("shipment_id", F.when(F.col("currency") == "", "USD").otherwise(F.col("currency")).alias("currency"))
    both = rows.join(_shipments(spark, d).select("shipment_id", T.filled("origin").alias("origin")), "shipment_id").select("origin", "currency").distinct()
    symbol = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in forms.SYMBOLS.items() for v in p]), F.col("currency")), F.col("currency"))
    return both.select("origin", F.upper("origin").alias("origin_upper"), "currency", symbol.alias("symbol"))
