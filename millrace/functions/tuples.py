"""Tuples of columns: unzipping, single or several results, formatting."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find(value: Any, values: Sequence) -> int:
    """Index of the first equal element; ``len(values)`` if there is none."""
    return next((i for i, v in enumerate(values) if v == value), len(values))


def contains(value: Any, values: Iterable) -> bool:
    return any(v == value for v in values)


def maybe_tuple(*values: Any) -> Any:
    """One value as it is, several (or none) as a tuple."""
    return values[0] if len(values) == 1 else values


def maybe_untuple(value: Any) -> Any:
    """The value of a tuple of one, else the value itself."""
    return value[0] if isinstance(value, tuple) and len(value) == 1 else value


def as_tuple(value: Any) -> tuple:
    return value if isinstance(value, tuple) else tuple(value) if isinstance(value, list) else (value,)


def for_each(values: Iterable, fun: Callable) -> Callable:
    for v in values:
        fun(v)
    return fun


def for_each_with_index(values: Iterable, fun: Callable) -> Callable:
    for i, v in enumerate(values):
        fun(v, i)
    return fun


def times_with_index(n: int, fun: Callable) -> Callable:
    for i in range(n):
        fun(i)
    return fun


def transformed(values: Iterable, fun: Callable) -> tuple:
    return tuple(fun(v) for v in values)


def transformed_with_index(values: Iterable, fun: Callable) -> tuple:
    return tuple(fun(v, i) for i, v in enumerate(values))


def offsets(start: int, n: int) -> tuple[int, ...]:
    return tuple(range(start, start + n))


def text(values: Iterable) -> str:
    """``(a, b)``."""
    return "(" + ", ".join(map(str, values)) + ")"


def unzip(rows: Iterable[Sequence]) -> tuple[list, ...]:
    """Columns of rows on the host."""
    rows = list(rows)
    return tuple(map(list, zip(*rows, strict=True))) if rows else ()


def unzip_if(several: bool, rows: Iterable) -> Any:
    return unzip(rows) if several else list(rows)


def unzip_groups(df: DataFrame, struct_col: str, key: str, order: str) -> DataFrame:
    """For each key an array of every field of a struct column, in the given order."""
    fields = df.schema[struct_col].dataType.names
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, struct_col))).alias("_rows"))
    return rows.select(key, *(_field("_rows", struct_col, f) for f in fields))


def _field(rows: str, struct_col: str, name: str):
    return F.transform(rows, lambda x: x[struct_col][name]).alias(name)
