"""User filters compiled to one predicate column."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import dtype, is_integral, is_temporal, label, ref
from ..specs import Filter, SpecError


def apply_filters(df: DataFrame, filters: Iterable[Filter] = (), allowed: set[str] | None = None) -> DataFrame:
    """Rows meeting every filter. ``allowed`` restricts which columns may be used."""
    clauses = []
    for f in filters:
        if allowed is not None and f.column not in allowed:
            raise SpecError(f"column {f.column!r} is not offered as a filter")
        clauses.extend(_clauses(df, f))
    return df.where(reduce(and_, clauses)) if clauses else df


def _blank(value) -> bool:
    return value is None or value == ""


def _literal(df: DataFrame, column: str, value) -> Column:
    kind = "timestamp_ntz" if is_temporal(df, column) else dtype(df, column)
    return F.lit(value).cast(kind)


def _clauses(df: DataFrame, f: Filter) -> list[Column]:
    col = ref(df, f.column)
    if f.operator == "in":
        given = f.value if isinstance(f.value, (list, tuple)) else [f.value]
        given = [v for v in given if not _blank(v)]
        return [_membership(df, f.column, given)] if given else []
    if f.operator == "between":
        if not isinstance(f.value, (list, tuple)) or len(f.value) != 2:
            return []
        low, high = f.value
        parts = [] if _blank(low) else [col >= _literal(df, f.column, low)]
        return parts if _blank(high) else parts + [col <= _literal(df, f.column, high)]
    if _blank(f.value):
        return []
    bound = _literal(df, f.column, f.value)
    return [{"eq": col == bound, "gte": col >= bound, "lte": col <= bound}[f.operator]]


def _membership(df: DataFrame, column: str, values: list) -> Column:
    """Compared as text, yet pushed to the scan as integers where that is the same."""
    col = ref(df, column)
    if is_temporal(df, column):
        return col.isin(*[_literal(df, column, v) for v in values])
    texts = [str(v).lower() if isinstance(v, bool) else str(v) for v in values]
    if is_integral(df, column):
        whole = [int(t) for t in texts if t.lstrip("-").isdigit() and str(int(t)) == t]
        return col.isin(*whole) if whole else F.lit(False)
    return label(df, column).isin(*texts)
