"""Filter trees compiled to one boolean column.

A leaf has a field, an operator in any of its spellings, and a value as text; a group has ``logic`` AND, OR or NOT over
``filters``. A list of filters is a conjunction. NULL follows SQL: a comparison with NULL is unknown, and only rows for which the
whole is true pass. Values are converted to the column's type; one that can't be is an error. Unknown fields are skipped, a
group without a known child is skipped, and it is an error if nothing remains (or, with ``strict``, if any field is unknown).
NOT takes exactly one child. IN lists are texts separated by commas or JSON arrays; members that can't be converted are
skipped, and a list without any other matches nothing (IN) or everything (NOT IN). CONTAINS and LIKE both look for the value within
a text. The compiled column reaches the parquet scan as pushed filters wherever Spark can push them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: spellings of the operators
OPERATORS = {
    "=": ("=", "==", "eq"), "!=": ("!=", "<>", "neq", "ne"), ">": (">", "gt"), "<": ("<", "lt"), ">=": (">=", "ge", "gte"), "<=": ("<=", "le", "lte"),
    "in": ("in",), "not in": ("not in", "not_in", "notin"), "contains": ("contains", "like"),
}
TRUE = ("1", "t", "T", "TRUE", "true", "True")
FALSE = ("0", "f", "F", "FALSE", "false", "False")


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    field: str = ""
    op: str = "="
    value: str = ""
    logic: str = ""
    filters: tuple[Filter, ...] = ()


def leaf(name: str, op: str, value: object) -> Filter:
    return Filter(name, op, value if isinstance(value, str) else json.dumps(value))


def both(*filters: Filter) -> Filter:
    return Filter(logic="AND", filters=filters)


def either(*filters: Filter) -> Filter:
    return Filter(logic="OR", filters=filters)


def negated(f: Filter) -> Filter:
    return Filter(logic="NOT", filters=(f,))


def parse(obj: dict) -> Filter:
    """A filter from its JSON object; unknown keys are skipped, ``op`` stands for ``operator``."""
    value = obj.get("value", "")
    if isinstance(value, bool) or value is None:
        raise FilterError("a value is a string or a number")
    return Filter(obj.get("field") or "", obj.get("operator") or obj.get("op") or "=", value if isinstance(value, str) else json.dumps(value), (obj.get("logic") or "").upper(), tuple(parse(x) for x in obj.get("filters") or ()))


def converted(value: str, kind: T.DataType) -> object:
    """The value as the column's type; FilterError if it isn't one."""
    try:
        if isinstance(kind, T.StringType):
            return value
        if isinstance(kind, T.BooleanType):
            if value in TRUE or value in FALSE:
                return value in TRUE
            raise ValueError(value)
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, T.FractionalType):
            return float(value)
        if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
            t = datetime.fromisoformat(value.replace("Z", "+00:00"))
            t = t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
            return t.date() if isinstance(kind, T.DateType) else t
    except ValueError as e:
        raise FilterError(f"{value!r} is no {kind.simpleString()}") from e
    raise FilterError(f"columns of type {kind.simpleString()} can't be filtered")


def literal(value: str, kind: T.DataType) -> Column:
    v = converted(value, kind)
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz").cast(kind) if isinstance(v, datetime) else F.lit(v).cast(kind)


def members(value: str, kind: T.DataType) -> list[object]:
    try:
        raw = json.loads(value) if value.lstrip().startswith("[") else value.split(",")
    except ValueError:
        raw = value.split(",")
    out = []
    for x in raw:
        try:
            out.append(converted((x if isinstance(x, str) else json.dumps(x)).strip(), kind))
        except FilterError:
            continue
    return out


def compiled(f: Filter, schema: T.StructType, strict: bool = False) -> Column | None:
    """The filter as a column, or None if it names no known field."""
    if f.logic:
        if f.logic == "NOT":
            if len(f.filters) != 1:
                raise FilterError("NOT takes exactly one filter")
            inner = compiled(f.filters[0], schema, strict)
            return F.lit(False) if inner is None else ~inner
        if f.logic not in ("AND", "OR"):
            raise FilterError(f"unknown logic {f.logic!r}")
        parts = [c for c in (compiled(x, schema, strict) for x in f.filters) if c is not None]
        return reduce((lambda a, b: a & b) if f.logic == "AND" else (lambda a, b: a | b), parts) if parts else None
    if f.field not in schema.names:
        if strict:
            raise FilterError(f"no column {f.field!r}")
        return None
    op = next((k for k, spellings in OPERATORS.items() if f.op.strip().lower() in spellings), None)
    if op is None:
        raise FilterError(f"unknown operator {f.op!r}")
    kind = schema[f.field].dataType
    c = F.col(f"`{f.field}`")
    if op in ("in", "not in"):
        values = members(f.value, kind)
        return (c.isin(values) if op == "in" else ~c.isin(values)) if values else F.lit(op == "not in")
    if op == "contains":
        if not isinstance(kind, T.StringType):
            raise FilterError("only texts contain")
        return c.contains(f.value)
    v = literal(f.value, kind)
    return {"=": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]


def apply(df: DataFrame, filters: Iterable[Filter], strict: bool = False) -> DataFrame:
    """The rows for which all filters are true; without filters, all rows."""
    given = list(filters)
    if not given:
        return df
    parts = [c for c in (compiled(f, df.schema, strict) for f in given) if c is not None]
    if not parts:
        raise FilterError("no filter names a known column")
    return df.where(reduce(lambda a, b: a & b, parts))
