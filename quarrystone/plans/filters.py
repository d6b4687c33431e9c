"""Filter trees: conditions joined by all/any groups, as plain data, compiled to one column expression.

A condition is {"field", "op", "value"}, a group {"op": "and" | "or", "items": [...]}. Unfinished conditions (no field, or an
operator that needs a value without one) and empty groups are left out, they never make a filter match nothing.
Every edit gives a new tree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.scalars import coerce_number, text_of

NEEDS_VALUE = {"is", "isnot", "contains", "notcontains", "eq", "neq", "gt", "gte", "lt", "lte"}
OPS = NEEDS_VALUE | {"empty", "notempty"}


def condition(field: str = "", op: str = "is", value: str = "") -> dict:
    return {"field": field, "op": op, "value": value}


def group(op: str = "and", *items: dict) -> dict:
    return {"op": op, "items": list(items)}


def is_group(x: dict) -> bool:
    return "items" in x


def finished(c: dict) -> bool:
    return bool(c.get("field")) and c.get("op") in OPS and (c["op"] not in NEEDS_VALUE or str(c.get("value") if c.get("value") is not None else "").strip() != "")


def test(c: dict, get: Callable[[str], Column]) -> Column:
    x, op, v = get(c["field"]), c["op"], str(c.get("value", "")).strip()
    t, l = F.lower(F.trim(text_of(x))), v.lower()
    if op in ("gt", "gte", "lt", "lte"):
        a, b = coerce_number(x), coerce_number(F.lit(v))
        by = {"gt": lambda p, q: p > q, "gte": lambda p, q: p >= q, "lt": lambda p, q: p < q, "lte": lambda p, q: p <= q}[op]
        # Numbers where both sides are numbers, else as texts.
        return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), by(a, b)).otherwise(by(t, F.lit(l)) & (t != "")), F.lit(False))
    return {
        "is": t == l, "eq": t == l, "isnot": t != l, "neq": t != l,
        "contains": F.contains(t, F.lit(l)), "notcontains": ~F.contains(t, F.lit(l)),
        "empty": t == "", "notempty": t != "",
    }[op]


def compile_tree(tree: dict, get: Callable[[str], Column] = F.col) -> Column | None:
    """The tree's expression; None if nothing in it is finished."""
    if not is_group(tree):
        return test(tree, get) if finished(tree) else None
    got = [c for c in (compile_tree(x, get) for x in tree["items"]) if c is not None]
    if not got:
        return None
    return reduce((lambda a, b: a | b) if tree["op"] == "or" else (lambda a, b: a & b), got)


def apply(df: DataFrame, tree: dict) -> DataFrame:
    c = compile_tree(tree, lambda f: df[f])
    return df if c is None else df.filter(c)


def active_count(tree: dict) -> int:
    return sum(active_count(x) for x in tree["items"]) if is_group(tree) else int(finished(tree))


def at(tree: dict, path: list[int]) -> dict:
    return reduce(lambda t, i: t["items"][i], path, tree)


def _edit(tree: dict, path: list[int], f: Callable[[dict], dict | None]) -> dict | None:
    if not path:
        return f(tree)
    i, new = path[0], _edit(tree["items"][path[0]], path[1:], f)
    return {**tree, "items": [*tree["items"][:i], *([new] if new is not None else []), *tree["items"][i + 1 :]]}


def add(tree: dict, path: list[int], item: dict) -> dict:
    return _edit(tree, path, lambda g: {**g, "items": [*g["items"], item]})


def remove(tree: dict, path: list[int]) -> dict:
    return _edit(tree, path, lambda _: None) if path else group(tree["op"])


def set_op(tree: dict, path: list[int], op: str) -> dict:
    return _edit(tree, path, lambda g: {**g, "op": op})


def patch(tree: dict, path: list[int], **change) -> dict:
    """Changing the field starts its operator and value anew."""
    fresh = {"op": "is", "value": ""} if "field" in change else {}
    return _edit(tree, path, lambda c: {**c, **fresh, **change})


def without(tree: dict, field: str) -> dict:
    """The tree without a field's conditions: what a facet of that field is counted under."""
    if not is_group(tree):
        return tree
    return {**tree, "items": [without(x, field) for x in tree["items"] if is_group(x) or x.get("field") != field]}


def flatten(tree: dict, path: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], dict]]:
    """(path, node) of every node, parents first."""
    own = [(path, tree)]
    return own + [y for i, x in enumerate(tree["items"]) for y in flatten(x, (*path, i))] if is_group(tree) else own


def facet(df: DataFrame, field: str, tree: dict | None = None) -> DataFrame:
    """(value, n): distinct non-blank values by count, under the rest of the tree."""
    src = apply(df, without(tree, field)) if tree else df
    v = F.trim(text_of(src[field]))
    return src.select(v.alias("value")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
