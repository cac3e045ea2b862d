"""Small spreadsheets: formulas compiled to column expressions over one wide row per workbook.

Formulas are parsed on the driver. Their references form a graph, whose order gives one projection a level; a workbook is
one row, so any number of them is a map-only job. Cyclic sheets are evaluated in a bounded number of passes.

Values are typed as struct<kind, num, txt>: 'n' a number, 's' a text, 'b' a truth value (num 1 or 0), 'e' an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions.numbers import cleaned_number
from waybill.functions.text import filled
from waybill.session import python_trim

PASSES = 6
_TOKEN = re.compile(r'\s*(?:(?P<text>"(?:[^"]|"")*")|(?P<number>\d+(?:\.\d+)?)|(?P<call>[A-Za-z]+)\(|(?P<ref>\$?[A-Za-z]{1,3}\$?\d+)|(?P<op><>|<=|>=|[=<>+\-*/&(),]))')


class Unsupported(ValueError):
    """A formula that this engine doesn't evaluate."""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple
    value: object = None


def parse(formula: str) -> Node:
    """The tree of a formula; comparison binds least, then &, + and -, * and /, minus; one comparison a level."""
    tokens, at = [], 0
    source = formula.lstrip("=").strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise Unsupported(formula)
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def peek() -> str:
        return tokens[place][1] if tokens[place][0] in ("op", "end") else ""

    def step() -> tuple[str, str]:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def chain(lower, ops: tuple[str, ...], once: bool = False):
        def level() -> Node:
            out = lower()
            while peek() in ops and peek():
                op = step()[1]
                out = Node(op, (out, lower()))
                if once:
                    break
            return out

        return level

    def primary() -> Node:
        kind, value = step()
        if kind == "text":
            return Node("text", (), value[1:-1].replace('""', '"'))
        if kind == "number":
            return Node("number", (), float(value))
        if kind == "ref":
            return Node("ref", (), value.replace("$", "").upper())
        if kind == "call":
            args = []
            if peek() == ")":
                step()
            else:
                while True:
                    args.append(compare())
                    closing = step()[1]
                    if closing == ")":
                        break
                    if closing != ",":
                        raise Unsupported(formula)
            if value.upper() != "IF" or len(args) not in (2, 3):
                raise Unsupported(formula)
            return Node("if", tuple(args))
        if (kind, value) == ("op", "("):
            inner = compare()
            if step()[1] != ")":
                raise Unsupported(formula)
            return inner
        raise Unsupported(formula)

    def unary() -> Node:
        if peek() == "-":
            step()
            return Node("neg", (unary(),))
        return primary()

    product = chain(unary, ("*", "/"))
    add = chain(product, ("+", "-"))
    concat = chain(add, ("&",))
    compare = chain(concat, ("=", "<>", "<", ">", "<=", ">="), once=True)
    tree = compare()
    if tokens[place][0] != "end":
        raise Unsupported(formula)
    return tree


def references(node: Node) -> set[str]:
    return {node.value} if node.op == "ref" else set().union(*[references(a) for a in node.args]) if node.args else set()


def value(kind: str, num: Column | None = None, txt: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if num is None else num).cast("double").alias("num"), (F.lit(None) if txt is None else txt).cast("string").alias("txt"))


BLANK = lambda: value("s", txt=F.lit(""))
ERROR = lambda: value("e")


def as_text(v: Column) -> Column:
    """A value as text: numbers without a fraction as whole numbers, truth values as words."""
    n = v["num"]
    whole = F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(n.cast("string"))
    return F.when(v["kind"] == "s", v["txt"]).when(v["kind"] == "b", F.when(n != 0, "TRUE").otherwise("FALSE")).otherwise(whole)


def as_number(v: Column) -> Column:
    """A value as a number: commas left out of texts, '' as 0; null if it is none."""
    t = F.replace(F.trim(v["txt"]), F.lit(","), F.lit(""))
    return F.when(v["kind"] == "s", F.when(t == "", 0.0).otherwise(t.try_cast("double"))).otherwise(v["num"])


def compile_node(node: Node, cell) -> Column:
    """The value column of a tree; ``cell`` gives the column of a reference. An error anywhere makes the whole an error."""
    args = [compile_node(a, cell) for a in node.args]
    if node.op == "text":
        return value("s", txt=F.lit(node.value))
    if node.op == "number":
        return value("n", num=F.lit(node.value))
    if node.op == "ref":
        return cell(node.value)
    return _bound(args, lambda values: _applied(node.op, values))


def _bound(args: list[Column], made) -> Column:
    """``made`` of the arguments, each of which stands in the expression once, so that chains of cells grow no faster than they are long."""
    held = F.array(F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)]))
    return F.get(F.transform(held, lambda s: made([s[f"a{i}"] for i in range(len(args))])), F.lit(0))


def _applied(op: str, args: list[Column]) -> Column:
    failed = None
    for a in args:
        failed = (a["kind"] == "e") if failed is None else failed | (a["kind"] == "e")
    if op == "if":
        other = args[2] if len(args) == 3 else value("b", num=F.lit(0.0))
        test = F.when(args[0]["kind"] == "s", F.lit(False)).otherwise(args[0]["num"] != 0)
        return F.when(failed, ERROR()).when(test, args[1]).otherwise(other)
    if op == "&":
        return F.when(failed, ERROR()).otherwise(value("s", txt=F.concat(as_text(args[0]), as_text(args[1]))))
    if op in ("=", "<>", "<", ">", "<=", ">="):
        texts = (args[0]["kind"] == "s") | (args[1]["kind"] == "s")
        low = [F.lower(F.trim(as_text(a))) for a in args]
        num = [a["num"] for a in args]
        say = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        return F.when(failed, ERROR()).otherwise(value("b", num=F.when(texts, say(*low)).otherwise(say(*num)).cast("double")))
    numbers = [as_number(a) for a in args]
    made = -numbers[0] if op == "neg" else {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": F.try_divide}[op](*numbers)
    return F.when(failed | made.isNull(), ERROR()).otherwise(value("n", num=made))


def evaluate(book: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Add or replace the value columns of formulas, over a table with one row a workbook and a value column a cell.

    A missing cell is ''; a formula that isn't supported, or fails, leaves ''. Cycles are passed over ``PASSES`` times.
    """
    trees: dict[str, Node | None] = {}
    for ref, text in formulas.items():
        try:
            trees[ref] = parse(text)
        except Unsupported:
            trees[ref] = None
    here = set(book.columns)
    settle = lambda v: _bound([v], lambda a: F.when(a[0]["kind"] == "e", BLANK()).otherwise(a[0]))
    done: set[str] = set()
    out = book
    todo = dict(trees)
    while todo:
        ready = [r for r, t in todo.items() if t is None or not (references(t) & (todo.keys() - {r})) and r not in references(t)]
        if not ready:
            break
        known = here | done
        cell = lambda r, known=known: F.col(r) if r in known else BLANK()
        out = out.withColumns({r: BLANK() if todo[r] is None else settle(compile_node(todo[r], cell)) for r in ready})
        done |= set(ready)
        for r in ready:
            del todo[r]
    if todo:
        out = out.withColumns({r: BLANK() for r in todo if r not in here | done})
        for _ in range(PASSES):
            for r, t in todo.items():
                known = here | done | set(todo)
                out = out.withColumn(r, settle(compile_node(t, lambda x, known=known: F.col(x) if x in known else BLANK())))
    return out


# The cells of the shipping sheet.
CELLS = {"shipment_mode": "A6", "product": "B8", "quantity": "B9", "price_label": "A10", "price_per_unit": "B10", "incoterms": "C9", "total": "C10", "specs": "B11", "origin": "B12", "label_type": "B14", "consignee": "B28"}


def sheet_inputs(orders: DataFrame) -> DataFrame:
    """One row a purchase order with the sheet's input cells as typed values, ``notes`` and the total's rule applied.

    The product of quantity and price stands in the total's cell unless the order states another total, which then wins.
    """
    t = lambda c: python_trim(filled(c))
    either = lambda c, default: F.when(t(c) == "", default).otherwise(t(c))
    mode = F.when(F.startswith(F.lower(either("shipment_mode", F.lit("Air"))), F.lit("sea")), "Sea").otherwise("Air")
    quantity, price, total = (F.coalesce(F.col(c).try_cast("double"), cleaned_number(c)) for c in ("quantity", "unit_price", "total_price"))

    other = (total != 0) & (F.abs(total - quantity * price) > 0.01)
    terms = F.when(t("shipping_terms") == "", "Inco terms:").otherwise(F.concat(F.lit("Inco terms: "), t("shipping_terms")))
    s = lambda c: value("s", txt=c)
    return orders.select(
        "po_id", s(F.concat(mode, F.lit(" Shipment"))).alias("A6"), s(t("product_name")).alias("B8"), value("n", num=quantity).alias("B9"),
        s(F.concat(F.lit("Price per "), F.upper(either("unit", F.lit("KG"))), F.lit(":"))).alias("A10"), value("n", num=price).alias("B10"), s(terms).alias("C9"),
        value("n", num=F.when(other, total).otherwise(quantity * price)).alias("C10"), s(t("origin_country")).alias("B12"), s(F.lit("full")).alias("B14"), s(t("consignee")).alias("B28"),
        F.when(other, F.concat(F.lit("stated total "), F.format_number(total, 2), F.lit(" against "), F.format_number(quantity * price, 2))).alias("notes"),
    )


__all__ = ["CELLS", "Unsupported", "as_number", "as_text", "compile_node", "evaluate", "parse", "sheet_inputs", "value"]
