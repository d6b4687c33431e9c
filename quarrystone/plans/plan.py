"""Query plans as data: {"intent", "type", "record", "filters", "agg", "sort", "limit"}.

A plan is checked against the tables and columns that are there before anything runs, so it can only read. ``compile_plan``
makes the DataFrame; unknown tables, fields, functions and operators are errors with the list of what is known.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.scalars import coerce_number, text_of
from quarrystone.plans import filters as ft

INTENTS = {"query", "aggregate", "profile", "search"}
FUNCTIONS = {"count", "sum", "avg", "min", "max"}
FILTERS = {"eq", "neq", "contains", "gt", "gte", "lt", "lte", "empty", "notempty"}


@dataclass
class Plan:
    type: str
    intent: str = "query"
    record: str | None = None
    filters: list[dict] = field(default_factory=list)
    agg: dict | None = None
    sort: dict | None = None
    limit: int | None = None

    @classmethod
    def from_json(cls, text: str) -> Plan:
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in json.loads(text).items() if k in known and v is not None})

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if v not in (None, [])}, sort_keys=True)


class PlanError(ValueError):
    pass


def check(plan: Plan, tables: dict[str, DataFrame]) -> None:
    if plan.intent not in INTENTS:
        raise PlanError(f"unknown intent {plan.intent!r}; known: {sorted(INTENTS)}")
    if plan.type not in tables:
        raise PlanError(f"unknown table {plan.type!r}; known: {sorted(tables)}")
    cols = set(tables[plan.type].columns)

    def need(name: str | None, what: str) -> None:
        if name is not None and name not in cols:
            raise PlanError(f"unknown field {name!r} in {what}; known: {sorted(cols)}")

    for f in plan.filters:
        need(f.get("field"), "filters")
        if f.get("op") not in FILTERS:
            raise PlanError(f"unknown operator {f.get('op')!r}; known: {sorted(FILTERS)}")
    if plan.agg:
        if plan.agg.get("fn") not in FUNCTIONS:
            raise PlanError(f"unknown function {plan.agg.get('fn')!r}; known: {sorted(FUNCTIONS)}")
        if plan.agg["fn"] != "count" or plan.agg.get("field"):
            need(plan.agg.get("field") or "", "agg")
        need(plan.agg.get("groupBy"), "agg")
    if plan.sort and not plan.agg:
        need(plan.sort.get("field"), "sort")
    if plan.limit is not None and (not isinstance(plan.limit, int) or plan.limit < 0):
        raise PlanError("limit must be a whole number, 0 or more")


def compile_plan(plan: Plan, tables: dict[str, DataFrame], label: str | None = None) -> DataFrame:
    """label: the column that names a record, for plan.record. Rows without the group's value group under an empty text."""
    check(plan, tables)
    df = tables[plan.type]
    df = ft.apply(df, ft.group("and", *[ft.condition(f["field"], f["op"], f.get("value", "")) for f in plan.filters]))
    if plan.record is not None and label:
        df = df.filter(F.lower(F.trim(text_of(df[label]))) == plan.record.strip().lower())
    if plan.agg:
        fn, name = plan.agg["fn"], plan.agg.get("field")
        number = None if not name else (df[name].cast("double") if dict(df.dtypes)[name] not in ("string",) else coerce_number(df[name]))
        value = {"count": lambda: F.count("*"), "sum": lambda: F.sum(number), "avg": lambda: F.avg(number), "min": lambda: F.min(number), "max": lambda: F.max(number)}[fn]()
        by = plan.agg.get("groupBy")
        df = df.groupBy(text_of(df[by]).alias(by)).agg(value.alias("value")) if by else df.agg(value.alias("value"))
    if plan.sort:
        c = plan.sort["field"] if plan.sort["field"] in df.columns else "value"
        if c in df.columns:
            down = plan.sort.get("dir") == "desc"
            df = df.orderBy(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last(), *[x for x in df.columns if x != c][:1])
    return df if plan.limit is None else df.limit(plan.limit)
