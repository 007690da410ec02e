"""Filter trees, strict literal typing, paging and limits."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_LIMIT = 500

_LITERALS = {
    T.StringType: (str,), T.BooleanType: (bool,), T.DoubleType: (float,), T.FloatType: (float,),
    T.LongType: (int,), T.IntegerType: (int,), T.ShortType: (int,), T.DateType: (dt.date,),
    T.TimestampType: (dt.datetime,), T.TimestampNTZType: (dt.datetime,),
}


def check_literal(df: DataFrame, name: str, value) -> None:
    """Refuse a literal whose type is not the column's; nothing is cast implicitly."""
    if name not in df.columns:
        raise KeyError(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        kind = kind.elementType
    for t, ok in _LITERALS.items():
        if isinstance(kind, t):
            if type(value) in ok or (value is None):
                return
            raise TypeError(f"{name} is {kind.simpleString()}, got {type(value).__name__} {value!r}")
    raise TypeError(f"{name}: no literal exists for {kind.simpleString()}")


_SCALAR = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v,
    "geq": lambda c, v: c >= v, "leq": lambda c, v: c <= v, "like": lambda c, v: c.like(v),
    "notlike": lambda c, v: ~c.like(v), "has": lambda c, v: F.array_contains(c, v),
}
_LISTED = {
    "in": lambda c, v: c.isin(list(v)), "notin": lambda c, v: ~c.isin(list(v)),
    "hasall": lambda c, v: F.size(F.array_except(F.array(*[F.lit(x) for x in v]), c)) == 0,
    "hasany": lambda c, v: F.arrays_overlap(c, F.array(*[F.lit(x) for x in v])),
}
_DOLLAR = {"$eq": "eq", "$ne": "neq", "$in": "in", "$nin": "notin", "$lt": "lt", "$lte": "leq", "$gt": "gt", "$gte": "geq"}


def _leaf(df: DataFrame, name: str, op: str, value) -> Column:
    if op in _LISTED:
        for v in value:
            check_literal(df, name, v)
        return _LISTED[op](F.col(name), value)
    if op not in _SCALAR:
        raise ValueError(f"unknown filter operator {op!r}")
    check_literal(df, name, value)
    return _SCALAR[op](F.col(name), value)


def filter_tree(df: DataFrame, tree: dict) -> Column:
    """A condition from `{field_op: value}` leaves and `AND` / `OR` lists."""
    parts = []
    for k, v in tree.items():
        if k in ("AND", "OR"):
            sub = [filter_tree(df, t) for t in v]
            parts.append(reduce((lambda a, b: a & b) if k == "AND" else (lambda a, b: a | b), sub))
            continue
        name, op = k, "eq"
        for cand in sorted((*_SCALAR, *_LISTED), key=len, reverse=True):
            if k.endswith(f"_{cand}") and k[: -len(cand) - 1] in df.columns:
                name, op = k[: -len(cand) - 1], cand
                break
        parts.append(_leaf(df, name, op, v))
    return reduce(lambda a, b: a & b, parts)


def metadata_filter(df: DataFrame, spec: dict) -> Column:
    """A condition from `{field: value}` or `{field: {"$op": value}}`."""
    parts = []
    for name, v in spec.items():
        ops = v if isinstance(v, dict) else {"$eq": v}
        parts += [_leaf(df, name, _DOLLAR[o], x) for o, x in ops.items()]
    return reduce(lambda a, b: a & b, parts)


def limited(df: DataFrame, n: int = DEFAULT_LIMIT) -> DataFrame:
    """At most `n` rows: the row limit of an interactive query, `DEFAULT_LIMIT` when none is given."""
    return df.limit(n)


def keyset_page(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The page after `last` in descending key order."""
    d = df if last is None else df.where(F.col(key) < F.lit(last))
    return d.orderBy(F.desc(key)).limit(size)


def top_groups(df: DataFrame, by: list[str], value: Column, k: int, name: str) -> DataFrame:
    """The `k` groups with the largest value; ties by group."""
    return df.groupBy(*by).agg(value.alias(name)).orderBy(F.desc(name), *by).limit(k)
