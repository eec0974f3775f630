"""Metadata predicates compiled to Column expressions.

A filter is a dict (every field equals its value), a condition ``{"field", "operator", "value"}``, a list of these (all
hold), or ``{"and": [...]}``, ``{"or": [...]}``, ``{"not": ...}`` of them. Fields are dotted paths. Comparison is typed as
in JSON: 1, "1" and true differ. A missing or null field fails every operator but ``$ne``, ``$nin`` and
``{"$exists": false}``. A record without metadata fails every filter that is not empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$regex")


@dataclass(frozen=True)
class Typed:
    """One field read as each type; each column is null unless the field holds that type. ``key`` is true also for null."""

    number: Column
    string: Column
    boolean: Column
    key: Column
    value: Column  # true if present and not null


class JsonFields:
    """Fields of a JSON string column. Malformed JSON counts as missing metadata."""

    def __init__(self, column: Column | str):
        self.text = F.col(column) if isinstance(column, str) else column
        self.document = F.try_parse_json(self.text)

    def present(self) -> Column:
        return self.document.isNotNull()

    def __call__(self, path: str) -> Typed:
        where = "$" + "".join('["' + part.replace("\\", "\\\\").replace('"', '\\"') + '"]' for part in path.split("."))
        kind = F.schema_of_variant(F.try_variant_get(self.document, where, "variant"))
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return Typed(
            number=F.when(numeric, F.try_variant_get(self.document, where, "double")),
            string=F.when(kind == "STRING", F.try_variant_get(self.document, where, "string")),
            boolean=F.when(kind == "BOOLEAN", F.try_variant_get(self.document, where, "boolean")),
            key=kind.isNotNull(),
            value=F.coalesce(kind != "VOID", F.lit(False)),
        )


class ColumnFields:
    """Fields that are columns, or fields of struct columns, of a DataFrame. ``root`` is a struct to start from."""

    def __init__(self, df: DataFrame, root: str | None = None):
        self.df, self.root = df, root

    def present(self) -> Column:
        return F.col(self.root).isNotNull() if self.root else F.lit(True)

    def __call__(self, path: str) -> Typed:
        parts = [*([self.root] if self.root else []), *path.split(".")]
        kind: Any = self.df.schema
        for part in parts:
            if not isinstance(kind, T.StructType) or part not in kind.names:
                none = F.lit(None)
                return Typed(none.cast("double"), none.cast("string"), none.cast("boolean"), F.lit(False), F.lit(False))
            kind = kind[part].dataType
        c = F.col(".".join(f"`{p}`" for p in parts))
        as_if = lambda types, to: c.cast(to) if isinstance(kind, types) else F.lit(None).cast(to)
        return Typed(as_if(T.NumericType, "double"), as_if(T.StringType, "string"), as_if(T.BooleanType, "boolean"), c.isNotNull(), c.isNotNull())


def _equals(f: Typed, value: Any) -> Column:
    if isinstance(value, bool):
        hit = f.boolean == F.lit(value)
    elif isinstance(value, (int, float)):
        hit = f.number == F.lit(float(value)) if not math.isnan(value) else F.lit(False)
    elif isinstance(value, str):
        hit = f.string == F.lit(value)
    else:
        hit = F.lit(False)  # null, lists and objects equal nothing
    return F.coalesce(hit, F.lit(False))


def _as_number(f: Typed) -> Column:
    text = F.trim(f.string)
    return F.coalesce(f.number, f.boolean.cast("int").cast("double"), F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double")))


def _compares(f: Typed, op: str, value: Any) -> Column:
    by = {"$gt": lambda x, y: x > y, "$gte": lambda x, y: x >= y, "$lt": lambda x, y: x < y, "$lte": lambda x, y: x <= y}[op]
    if isinstance(value, str):
        try:
            other = by(F.coalesce(f.number, f.boolean.cast("int").cast("double")), F.lit(float(value or 0)))
        except ValueError:
            other = F.lit(False)
        hit = F.when(f.string.isNotNull(), by(f.string, F.lit(value))).otherwise(other)
    elif isinstance(value, (bool, int, float)) and not (isinstance(value, float) and math.isnan(value)):
        number = _as_number(f)
        hit = F.when(~F.isnan(number), by(number, F.lit(float(value))))  # NaN compares as false
    else:
        hit = F.lit(False)
    return F.coalesce(hit, F.lit(False))


def condition(f: Typed, op: str, value: Any) -> Column:
    if op == "$eq":
        return f.value & _equals(f, value)
    if op == "$ne":
        return ~f.value | ~_equals(f, value)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return f.value & _compares(f, op, value)
    if op in ("$in", "$nin"):
        among = reduce(lambda a, b: a | b, [_equals(f, v) for v in value], F.lit(False))
        return f.value & among if op == "$in" else ~f.value | ~among
    if op == "$exists":
        return f.value if value else ~f.value
    if op == "$regex":
        return f.value & F.coalesce(f.string.rlike(value), F.lit(False))
    raise ValueError(f"unknown operator {op!r}; known: {', '.join(OPERATORS)}")


def _tree(filters: Any, fields) -> Column | None:
    if not filters:
        return None
    if isinstance(filters, (list, tuple)):
        parts = [p for p in (_tree(x, fields) for x in filters) if p is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None
    if not isinstance(filters, dict):
        raise TypeError("a filter is a dict or a list of dicts")
    if set(filters) in ({"and"}, {"or"}) and isinstance(next(iter(filters.values())), (list, tuple)):
        parts = [p for p in (_tree(x, fields) for x in next(iter(filters.values()))) if p is not None]
        return reduce((lambda a, b: a & b) if "and" in filters else (lambda a, b: a | b), parts) if parts else None
    if set(filters) == {"not"} and isinstance(filters["not"], (dict, list)):
        inner = _tree(filters["not"], fields)
        return None if inner is None else ~inner
    if "field" in filters and set(filters) <= {"field", "operator", "value"}:
        return condition(fields(filters["field"]), filters.get("operator", "$eq"), filters.get("value"))
    return reduce(lambda a, b: a & b, [condition(fields(k), "$eq", v) for k, v in filters.items()])


def compile_filter(filters: Any, fields) -> Column:
    """A boolean Column that is never null. ``fields`` is :class:`JsonFields` or :class:`ColumnFields`."""
    tree = _tree(filters, fields)
    return F.lit(True) if tree is None else F.coalesce(fields.present() & tree, F.lit(False))


def any_of(*filters: Any) -> dict:
    return {"or": list(filters)}


def all_of(*filters: Any) -> dict:
    return {"and": list(filters)}


def none_of(*filters: Any) -> dict:
    return {"not": {"or": list(filters)}}


def lookup(df: DataFrame, criteria: str | list[str] | dict[str, Any], values: list[Any] | None = None, limit: int | None = None, metadata: str = "metadata", order: str | None = None) -> DataFrame:
    """Records by metadata: with a key (null counts as present), with all of several keys (equal to ``values`` by place
    where given), or with fields equal to a dict's values. ``limit`` takes the first by ``order``."""
    fields = JsonFields(metadata) if isinstance(df.schema[metadata].dataType, T.StringType) else ColumnFields(df, metadata)
    if isinstance(criteria, dict):
        hit = compile_filter(criteria, fields) if criteria else fields.present()
    else:
        keys = [criteria] if isinstance(criteria, str) else list(criteria)
        hit = fields.present()
        for i, k in enumerate(keys):
            f = fields(k)
            hit = hit & f.key
            if values is not None and i < len(values):
                hit = hit & _equals(f, values[i])
    out = df.where(F.coalesce(hit, F.lit(False)))
    if limit is None:
        return out
    return (out.orderBy(order) if order else out).limit(limit)
