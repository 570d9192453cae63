"""Filters over JSON metadata, compiled to boolean columns.

The dictionary form has one key per field, with a plain value (equality) or
operators $eq $ne $in $gt $gte $lt $lte; several keys or operators all have to
hold. Or is there for programs only. Logic has two values: a filter is never null.
Rows whose metadata is missing or no object match nothing. Fields are literal
top-level keys. 1 and 1.0 are different values for equality, the same in order.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from starling.errors import InvalidFilter


class Filter:
    def __and__(self, other):
        return And((self, other))

    def __or__(self, other):
        return Or((self, other))


@dataclass(frozen=True)
class Eq(Filter):
    key: str
    value: object


@dataclass(frozen=True)
class Ne(Filter):
    key: str
    value: object


@dataclass(frozen=True)
class In(Filter):
    key: str
    values: tuple


@dataclass(frozen=True)
class Compare(Filter):
    key: str
    op: str
    value: float


def Gt(key, value):
    return Compare(key, "$gt", value)


def Gte(key, value):
    return Compare(key, "$gte", value)


def Lt(key, value):
    return Compare(key, "$lt", value)


def Lte(key, value):
    return Compare(key, "$lte", value)


@dataclass(frozen=True)
class And(Filter):
    parts: tuple


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple


ORDER = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def parse_filter(given) -> Filter:
    """A filter from its dictionary form; an empty dictionary is And of nothing, which matches no row."""
    if isinstance(given, Filter):
        return given
    if not isinstance(given, dict):
        raise InvalidFilter("a filter is a dictionary")
    parts: list[Filter] = []
    for key, value in given.items():
        if not isinstance(value, dict):
            parts.append(Eq(key, value))
            continue
        for op, v in value.items():
            if op == "$eq":
                parts.append(Eq(key, v))
            elif op == "$ne":
                parts.append(Ne(key, v))
            elif op == "$in":
                if not isinstance(v, (list, tuple)):
                    raise InvalidFilter("$in takes a list")
                parts.append(In(key, tuple(v)))
            elif op in ORDER:
                if isinstance(v, bool) or not isinstance(v, (int, float)):
                    raise InvalidFilter(f"{op} takes a number")
                parts.append(Compare(key, op, float(v)))
            else:
                raise InvalidFilter(f"unknown operator {op!r}")
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def _all(columns: list[Column], join) -> Column:
    return reduce(join, columns)


class JsonFields:
    """Fields of a JSON string column, each with its type."""

    def __init__(self, metadata: Column):
        self.variant = F.try_parse_json(metadata.cast("string"))
        self.is_object = F.coalesce(F.schema_of_variant(self.variant).startswith("OBJECT"), F.lit(False))

    def _path(self, key: str) -> str:
        quote = "'" if '"' in key else '"'
        if quote in key:
            raise InvalidFilter(f"the field {key!r} holds both kinds of quotes")
        return f"$[{quote}{key}{quote}]"

    def value(self, key: str) -> Column:
        return F.when(self.is_object, F.try_variant_get(self.variant, self._path(key), "variant"))

    def has(self, key: str) -> Column:
        return self.value(key).isNotNull()

    def kind(self, key: str) -> Column:
        return F.schema_of_variant(self.value(key))

    def equals(self, key: str, value) -> Column:
        value_of = lambda kind: F.try_variant_get(self.variant, self._path(key), kind)
        kind = self.kind(key)
        if value is None:
            found = kind == "VOID"
        elif isinstance(value, bool):
            found = (kind == "BOOLEAN") & (value_of("boolean") == F.lit(value))
        elif isinstance(value, int):
            found = ((kind == "BIGINT") | (kind.startswith("DECIMAL") & kind.endswith(",0)") & (F.length(value_of("string")) > 18))) & (value_of("decimal(38,0)") == F.lit(str(value)).cast("decimal(38,0)"))
        elif isinstance(value, float):
            found = (kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT")) & (value_of("double") == F.lit(value))
        elif isinstance(value, str):
            found = (kind == "STRING") & (value_of("string") == F.lit(value))
        else:
            found = (kind.startswith("ARRAY") | kind.startswith("OBJECT")) & (F.to_json(self.value(key)) == F.to_json(F.parse_json(F.lit(json.dumps(value)))))
        return F.coalesce(self.is_object & found, F.lit(False))

    def number(self, key: str) -> Column:
        kind = self.kind(key)
        numeric = (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT")
        return F.when(numeric, F.try_variant_get(self.variant, self._path(key), "double"))


class TypedFields:
    """Fields that are columns of their own; a null column is an absent key."""

    def __init__(self, columns: dict[str, Column], is_object: Column | None = None):
        self.columns, self.is_object = columns, F.lit(True) if is_object is None else is_object

    def has(self, key: str) -> Column:
        return self.columns[key].isNotNull() if key in self.columns else F.lit(False)

    def equals(self, key: str, value) -> Column:
        if value is None or key not in self.columns:
            return F.lit(False)
        return F.coalesce(self.columns[key] == F.lit(value), F.lit(False))

    def number(self, key: str) -> Column:
        return self.columns[key].cast("double") if key in self.columns else F.lit(None).cast("double")


def compile_filter(given, fields: JsonFields | TypedFields) -> Column:
    """A never-null boolean column."""
    f = parse_filter(given)
    if isinstance(f, Eq):
        return fields.equals(f.key, f.value)
    if isinstance(f, Ne):
        return F.coalesce(fields.is_object & (~fields.has(f.key) | ~fields.equals(f.key, f.value)), F.lit(False))
    if isinstance(f, In):
        return _all([fields.equals(f.key, v) for v in f.values], lambda a, b: a | b) if f.values else F.lit(False)
    if isinstance(f, Compare):
        return F.coalesce(ORDER[f.op](fields.number(f.key), F.lit(float(f.value))), F.lit(False))
    parts = [compile_filter(p, fields) for p in f.parts]
    if isinstance(f, Or):
        return _all(parts, lambda a, b: a | b) if parts else F.lit(False)
    return _all(parts, lambda a, b: a & b) if parts else F.lit(False)


def typed_condition(given, fields: TypedFields) -> Column:
    """For where(): keeps the rows that compile_filter keeps, but is null instead of false where a field is absent, so that it reaches the scan."""
    f = parse_filter(given)
    column = fields.columns.get(getattr(f, "key", None))
    if isinstance(f, (And, Or)) and f.parts:
        return _all([typed_condition(p, fields) for p in f.parts], (lambda a, b: a & b) if isinstance(f, And) else (lambda a, b: a | b))
    if column is not None and isinstance(f, Eq) and f.value is not None:
        return column == F.lit(f.value)
    if column is not None and isinstance(f, In) and f.values and all(v is not None for v in f.values):
        return column.isin(list(f.values))
    if column is not None and isinstance(f, Compare) and float(f.value).is_integer() and abs(f.value) < 1 << 53:
        return ORDER[f.op](column, F.lit(int(f.value)))
    return compile_filter(f, fields)


def metadata_filter(given, metadata: str | Column = "metadata") -> Column:
    return compile_filter(given, JsonFields(F.col(metadata) if isinstance(metadata, str) else metadata))


def promoted(metadata: str, keys: list[str]) -> dict[str, Column]:
    """Columns of a JSON column's fields: text_<n> where the n-th key holds a string, number_<n> where it holds a number."""
    fields, out = JsonFields(F.col(metadata)), {}
    for n, key in enumerate(keys):
        out[f"text_{n}"] = F.when(fields.is_object & (fields.kind(key) == "STRING"), F.try_variant_get(fields.variant, fields._path(key), "string"))
        out[f"number_{n}"] = F.when(fields.is_object, fields.number(key))
    return out


def implied(given, keys: list[str]) -> Column | None:
    """A condition on promoted columns that all rows meet which the filter keeps, and that reaches the scan; None if there is none."""
    f = parse_filter(given)
    if isinstance(f, (And, Or)):
        parts = [implied(p, keys) for p in f.parts]
        known = [p for p in parts if p is not None]
        if isinstance(f, And):
            return _all(known, lambda a, b: a & b) if known else None
        return _all(known, lambda a, b: a | b) if known and len(known) == len(parts) else None
    if f.key not in keys or isinstance(f, Ne):
        return None
    text, number = (F.col(f"{kind}_{keys.index(f.key)}") for kind in ("text", "number"))
    if isinstance(f, Compare):
        return ORDER[f.op](number, F.lit(f.value))
    values = f.values if isinstance(f, In) else (f.value,)
    if values and all(isinstance(v, str) for v in values):
        return text.isin(list(values))
    if values and all(type(v) in (int, float) and abs(v) < 1 << 53 for v in values):
        return number.isin([float(v) for v in values])
    return None
