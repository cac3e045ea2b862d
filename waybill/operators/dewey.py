"""Deeply nested records to related flat tables by Dewey labels.

Every node gets an ordinal path identifier (its Dewey label). A parent's identifier is its child's, truncated by one
step, so no join or lookup is needed to link a child to its parent, and all nodes that share a schema path (the label
without ordinals) form one table.

Two entrances:

* :func:`flatten_typed` for arrays of structs that Spark already types: JVM side only, one pass.
* :func:`flatten_json` for answers kept as text, whose shape isn't known: ``mapInArrow``-style batches of a Python
  walk, since wrappers, double encoding, fences and lists written as numbered objects defeat a fixed schema.

Both are narrow (no shuffle), so their cost grows with the bytes read and nothing else.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A nesting specification: field name -> specification of the lists of objects inside it.
Spec = Mapping[str, "Spec"]

NODE_SCHEMA = "node_path string, parent_path string, schema_path string, ordinals array<int>, payload string"

_FENCE = re.compile(r"^[^\[{\"]*```[A-Za-z]*\s*\n?(.*?)\n?\s*```", re.S)
_NUMBERED = re.compile(r"\d+\Z")
_STEP = re.compile(r"(?:^|\.)[^.\[\]]+\[\d+\]\Z")


def parent_of(path: str) -> str:
    """The parent's identifier: the label without its last step, '' at the top."""
    return _STEP.sub("", path)


def read_json(text: str | None):
    """The value a text encodes, however often it was encoded or fenced; None if it can't be read whole.

    Each reading leaves a shorter text, so it ends.
    """
    value = text
    while isinstance(value, str):
        value = value.strip().lstrip("\ufeff").strip()
        if fenced := _FENCE.match(value):
            value = fenced[1].strip()
        if not value or value[0] not in '[{"':
            return None
        try:
            value = json.loads(value, strict=False)
        except (ValueError, RecursionError):
            return None
    return value


def _elements(value) -> list:
    """The elements of what stands for a list: a list, a text that holds one, a numbered object, or a lone object."""
    if isinstance(value, str):
        value = read_json(value)
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        return list(value.values()) if value and all(_NUMBERED.match(k) for k in value) else [value]
    return []


def _lists(value, spec: Spec) -> dict[str, list]:
    """By name of the specification, what stands under it in the outermost objects that have it, in order, whatever wraps them.

    Each name is looked for on its own: an object that has some of the names is searched on for the others, but not
    inside the lists that were found.
    """
    found: dict[str, list] = {name: [] for name in spec}
    stack = [(value, tuple(spec))]
    while stack:
        value, wanted = stack.pop()
        if isinstance(value, str):
            value = read_json(value)
        if isinstance(value, dict):
            for name in wanted:
                if name in value:
                    found[name].append(value[name])
            left = tuple(name for name in wanted if name not in value)
            inside = [v for k, v in value.items() if k not in spec]
        else:
            left, inside = wanted, value if isinstance(value, list) else []
        if left:
            stack += [(v, left) for v in reversed(inside) if isinstance(v, (dict, list, str))]
    return found


def walk(value, spec: Spec) -> Iterator[tuple[str, str, list[int], dict]]:
    """(node path, schema path, ordinals, object) of each non-null object under the specification.

    Several records in one answer continue each other's ordinals, so that labels stay unique.
    """
    stack = []
    lists = _lists(value, spec)
    for name in reversed(list(spec)):
        at = 0
        found = []
        for held in lists[name]:
            for element in _elements(held):
                found.append((f"{name}[{at}]", name, [at], element, spec[name]))
                at += 1
        stack.extend(reversed(found))
    while stack:
        path, schema_path, ordinals, element, below = stack.pop()
        if isinstance(element, str):
            element = read_json(element)
        if not isinstance(element, dict):
            continue
        yield path, schema_path, ordinals, element
        for name in reversed(list(below)):
            children = [(f"{path}.{name}[{i}]", f"{schema_path}.{name}", [*ordinals, i], x, below[name]) for i, x in enumerate(_elements(element.get(name)))]
            stack.extend(reversed(children))


def flatten_json(df: DataFrame, key: str, column: str, spec: Spec, payload: bool = True) -> DataFrame:
    """One row per object of the lists named by ``spec`` inside the JSON text in ``column``.

    Result: ``key``, ``node_path`` (as ``a[0].b[2]``), ``parent_path`` ('' at the top), ``schema_path`` (as ``a.b``),
    ``ordinals`` and ``payload``, the object's own scalar fields as JSON text (null if not asked for).

    Defined cases: null, empty, truncated or unreadable texts give no rows; null elements keep their position and give
    no row; a lone object counts as a list of one, an object whose keys are all numbers as a list in stored order; a
    blank object gives a row; other fields are ignored; equal input rows give equal output rows (nothing is deduped);
    an empty table gives an empty result; extra columns of the input, whatever their names, are left out.
    """
    names = ["_key", "node_path", "parent_path", "schema_path", "ordinals", "payload"]
    batch_rows = 20_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch["_key"], batch["_text"], strict=True):
                for path, schema_path, ordinals, element in walk(read_json(text), spec):
                    own = json.dumps({n: v for n, v in element.items() if not isinstance(v, (dict, list))}, ensure_ascii=False) if payload else None
                    out.append((k, path, parent_of(path), schema_path, ordinals, own))
                if len(out) >= batch_rows:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    source = df.select(F.col(key).alias("_key"), F.col(column).cast("string").alias("_text")).where("_text IS NOT NULL")
    kind = dict(source.dtypes)["_key"]
    return source.mapInPandas(run, f"_key {kind}, {NODE_SCHEMA}").withColumnRenamed("_key", key)


def _own_fields(kind: StructType) -> list[str]:
    return [f.name for f in kind.fields if f.dataType.typeName() not in ("array", "struct", "map")]


def flatten_typed(df: DataFrame, key: str, spec: Spec, payload: bool = True) -> DataFrame:
    """As :func:`flatten_json`, for columns that are already arrays of structs; JVM expressions only.

    The nodes of a row are built as one array, level in level, and exploded once, so the source is read once, and only
    the nested columns of the specification. Null arrays and null elements give no row, elements keep their position,
    blank structs give a row.
    """
    if not spec:
        raise ValueError("the specification names no list")
    node_type = "array<struct<node_path:string,parent_path:string,schema_path:string,ordinals:array<int>,payload:string>>"
    none = F.array().cast(node_type)

    def nodes(column: Column, below: Spec, kind: StructType, name: str, parent: Column, ordinals: Column, schema_path: str) -> Column:
        own = _own_fields(kind)

        def node(x: Column, i: Column) -> Column:
            path = F.concat(F.when(parent != "", F.concat(parent, F.lit("."))).otherwise(F.lit("")), F.lit(f"{name}["), i.cast("string"), F.lit("]"))
            label = F.concat(ordinals, F.array(i.cast("int")))
            held = F.to_json(F.struct(*[x[n].alias(n) for n in own]), {"ignoreNullFields": "false"}) if payload and own else F.lit(None).cast("string")
            this = F.array(F.struct(path.alias("node_path"), parent.alias("parent_path"), F.lit(schema_path).alias("schema_path"), label.alias("ordinals"), held.alias("payload")))
            deeper = [nodes(x[n], s, kind[n].dataType.elementType, n, path, label, f"{schema_path}.{n}") for n, s in below.items()]
            return F.when(x.isNull(), none).otherwise(F.concat(this, *deeper))

        return F.coalesce(F.flatten(F.transform(column, node)), none)

    every = [nodes(F.col(f"_top.`{n}`"), s, df.schema[n].dataType.elementType, n, F.lit(""), F.array().cast("array<int>"), n) for n, s in spec.items()]
    top = df.select(F.col(key).alias("_key"), F.struct(*[F.col(n) for n in spec]).alias("_top"))
    return top.select("_key", F.inline(F.concat(*every) if len(every) > 1 else every[0])).withColumnRenamed("_key", key)


def child_table(df: DataFrame, key: str, schema_path: str) -> DataFrame:
    """The table of one schema path of typed columns: ``key``, ``node_path``, ``parent_path`` and the objects' own fields, typed.

    ``(key, node_path)`` identifies a row, ``(key, parent_path)`` points to its row in the table above. Null arrays and
    elements give no row; fields named like the three keys get the prefix ``field_``.
    """
    kind, path, frame = df.schema, F.lit(""), df.select(F.col(key).alias("_key"), F.struct(*[F.col(schema_path.split(".")[0])]).alias("_node"))
    for depth, name in enumerate(schema_path.split(".")):
        kind = kind[name].dataType.elementType
        frame = frame.select("_key", *(["_path"] if depth else []), F.posexplode(F.col(f"_node.`{name}`")).alias("_ix", "_node")).where("_node IS NOT NULL")
        parent = F.col("_path") if depth else F.lit("")
        path = F.concat(*([parent, F.lit(".")] if depth else []), F.lit(f"{name}["), F.col("_ix").cast("string"), F.lit("]"))
        frame = frame.select("_key", path.alias("_path"), parent.alias("_parent"), "_node")
    taken = {key, "node_path", "parent_path"}
    own = [F.col(f"_node.`{n}`").alias(f"field_{n}" if n in taken else n) for n in _own_fields(kind)]
    return frame.select(F.col("_key").alias(key), F.col("_path").alias("node_path"), F.col("_parent").alias("parent_path"), *own)


def tables(nodes: DataFrame, key: str, columns: Mapping[str, str]) -> dict[str, DataFrame]:
    """The nodes of each schema path (with its own fields as a DDL string) as a typed table of its own.

    For nodes of :func:`flatten_json` with payload: values that don't fit their type are null, fields that the DDL
    doesn't name are left out.
    """
    return {p: nodes.where(F.col("schema_path") == p).select(key, "node_path", "parent_path", F.from_json("payload", ddl).alias("_own")).select(key, "node_path", "parent_path", "_own.*") for p, ddl in columns.items()}
