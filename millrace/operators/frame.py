"""The text table: named or nameless string columns in row order, with typed views."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.strings import string_to
from millrace.operators.layout import POS, numbered

Convert = Callable[[Column], Column]


class TextTable:
    """A DataFrame of string columns and a 0-based position. ``names`` is None for a table without a header; its columns are then c0, c1, ..."""

    def __init__(self, df: DataFrame, names: Sequence[str] | None):
        self.df = df
        self.names = None if names is None else list(names)
        if self.names is not None:
            if len(set(self.names)) != len(self.names):
                raise ValueError("header names repeat")
            if any(not n for n in self.names):
                raise ValueError("a header name is empty")
            if len(self.names) != self.n_cols():
                raise ValueError("the header's size differs from the number of columns")

    # construction

    @staticmethod
    def of(spark: SparkSession, columns: Sequence[Sequence[Any]], names: Sequence[str] | None = None) -> TextTable:
        """From host columns; every value becomes text."""
        if len({len(c) for c in columns}) > 1:
            raise ValueError("the columns have different lengths")
        schema = ", ".join([f"{POS} long", *(f"c{i} string" for i in range(len(columns)))])
        rows = [(i, *(_text(v) for v in r)) for i, r in enumerate(zip(*columns, strict=True))]
        return TextTable(spark.createDataFrame(rows, schema), names)

    @staticmethod
    def from_df(df: DataFrame, order_by: Sequence[str] | str) -> TextTable:
        """From any DataFrame: columns cast to text, rows in the order of unique keys; null becomes the empty text."""
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        rows = numbered(df, order)
        return TextTable(rows.select(POS, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(df.columns))), df.columns)

    # shape and names

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != POS]

    def n_cols(self) -> int:
        return len(self.columns)

    def n_rows(self) -> int:
        return self.df.count() if self.columns else 0

    def header(self) -> list[str]:
        return list(self.names or [])

    def with_header(self, names: Sequence[str]) -> TextTable:
        """Renames all columns; no names take the header away."""
        return TextTable(self.df, list(names) or None)

    def _icol(self, i: int) -> str:
        if not 0 <= i < self.n_cols():
            raise IndexError(f"no column {i}")
        return self.columns[i]

    def _index(self, name: str) -> int:
        if self.names is None or name not in self.names:
            raise KeyError(f"no column {name}")
        return self.names.index(name)

    def _renumbered(self, df: DataFrame, names: list[str] | None) -> TextTable:
        old = [c for c in df.columns if c != POS]
        return TextTable(df.select(POS, *(F.col(c).alias(f"c{i}") for i, c in enumerate(old))), names)

    # changes

    def insert_col(self, values: Sequence[Any] | DataFrame, name: str | None = None) -> TextTable:
        """Appends a column: host values, or a DataFrame (_pos, value). A table with a header needs a name, one without takes none; a table without rows takes any length."""
        if self.columns and (self.names is None) != (name is None):
            raise ValueError("a name is needed just where there is a header")
        spark = self.df.sparkSession
        new = values if isinstance(values, DataFrame) else spark.createDataFrame([(i, _text(v)) for i, v in enumerate(values)], f"{POS} long, value string")
        new = new.select(F.col(POS), F.col("value").cast("string").alias(f"c{self.n_cols()}"))
        names = None if name is None else [*(self.names or []), name]
        if not self.columns or self.n_rows() == 0:
            blank = [F.lit("").alias(c) for c in self.columns]
            return TextTable(new.select(POS, *blank, f"c{self.n_cols()}"), names)
        if new.count() != self.n_rows():
            raise ValueError("the column's length differs from the table's")
        return TextTable(self.df.join(new, POS), names)

    def insert_row(self, values: Sequence[Any]) -> TextTable:
        """Appends a row; its size must be the number of columns."""
        if len(values) != self.n_cols() or not self.columns:
            raise ValueError("the row's size differs from the number of columns")
        row = self.df.agg(F.coalesce(F.max(POS) + 1, F.lit(0)).alias(POS), *(F.lit(_text(v)).alias(c) for c, v in zip(self.columns, values, strict=True)))
        return TextTable(self.df.unionByName(row), self.names)

    def drop_icol(self, i: int) -> TextTable:
        names = None if self.names is None else self.names[:i] + self.names[i + 1 :]
        return self._renumbered(self.df.drop(self._icol(i)), names)

    def drop_col(self, name: str) -> TextTable:
        return self.drop_icol(self._index(name))

    def drop_row(self, i: int) -> TextTable:
        """Drops a row; those after it move up."""
        if not 0 <= i < self.n_rows():
            raise IndexError(f"no row {i}")
        return TextTable(self.df.where(F.col(POS) != i).withColumn(POS, F.col(POS) - F.when(F.col(POS) > i, 1).otherwise(0)), self.names)

    def set_value(self, i: int, column: int | str, value: Any) -> TextTable:
        c = self._icol(column if isinstance(column, int) else self._index(column))
        return TextTable(self.df.withColumn(c, F.when(F.col(POS) == i, F.lit(_text(value))).otherwise(F.col(c))), self.names)

    # views

    def icols(self, which: Sequence[int], kinds: Sequence[str] | None = None, convert: Sequence[Convert | None] | None = None) -> DataFrame:
        """Columns by number in the given order, typed: strict casts, or own conversions. Named as the header says. With _pos."""
        kinds = kinds or ["string"] * len(which)
        convert = convert or [None] * len(which)
        out = []
        for i, kind, f in zip(which, kinds, convert, strict=True):
            c = F.col(self._icol(i))
            out.append((f(c).cast(kind) if f else string_to(c, kind)).alias(self.names[i] if self.names else f"c{i}"))
        return self.df.select(POS, *out)

    def cols(self, names: Sequence[str], kinds: Sequence[str] | None = None, convert: Sequence[Convert | None] | None = None) -> DataFrame:
        return self.icols([self._index(n) for n in names], kinds, convert)

    def _ordered(self, df: DataFrame) -> list[tuple]:
        return [tuple(r)[1:] for r in df.orderBy(POS).collect()]

    def raw_cols(self, names: Sequence[str] | None = None) -> list[list[str]]:
        rows = self.raw_rows(names)
        n = self.n_cols() if names is None else len(names)
        return [[r[k] for r in rows] for k in range(n)]

    def raw_icols(self, which: Sequence[int]) -> list[list[str]]:
        rows = self._ordered(self.icols(which))
        return [[r[k] for r in rows] for k in range(len(which))]

    def icol(self, i: int, kind: str = "string", convert: Convert | None = None) -> list:
        return [r[0] for r in self._ordered(self.icols([i], [kind], [convert]))]

    def col(self, name: str, kind: str = "string", convert: Convert | None = None) -> list:
        return self.icol(self._index(name), kind, convert)

    def raw_rows(self, names: Sequence[str] | None = None) -> list[tuple]:
        return self._ordered(self.icols(range(self.n_cols())) if names is None else self.cols(names))

    def raw_irows(self, which: Sequence[int]) -> list[tuple]:
        return self._ordered(self.icols(which))

    def irows(self, which: Sequence[int], kinds: Sequence[str], convert: Sequence[Convert | None] | None = None) -> list[tuple]:
        return self._ordered(self.icols(which, kinds, convert))

    def rows(self, names: Sequence[str], kinds: Sequence[str], convert: Sequence[Convert | None] | None = None) -> list[tuple]:
        return self._ordered(self.cols(names, kinds, convert))

    def index_cols(self, key: str, values: Sequence[str], key_kind: str = "string", kinds: Sequence[str] | None = None) -> DataFrame:
        """key and the value columns, one row for each key: the first of its rows."""
        return self.index_icols(self._index(key), [self._index(v) for v in values], key_kind, kinds)

    def index_icols(self, key: int, values: Sequence[int], key_kind: str = "string", kinds: Sequence[str] | None = None) -> DataFrame:
        df = self.icols([key, *values], [key_kind, *(kinds or ["string"] * len(values))])
        old = [c for c in df.columns if c != POS]
        names = ["key", *(f"value{i}" for i in range(len(values)))]
        df = df.toDF(POS, *names)
        first = df.groupBy("key").agg(F.min_by(F.struct(*names[1:]), POS).alias("_v"))
        shown = ["value"] if len(values) == 1 else old[1:]
        return first.select("key", *(F.col("_v")[n].alias(s) for n, s in zip(names[1:], shown, strict=True)))

    def data(self) -> DataFrame:
        """The columns under their names, with _pos."""
        return self.icols(range(self.n_cols()))

    def __str__(self) -> str:
        """Right-aligned columns between bars, the header over a line."""
        rows = self.raw_rows()
        lines = ([tuple(self.names)] if self.names else []) + rows
        if not lines:
            return ""
        widths = [max(len(r[k]) for r in lines) + 2 for k in range(len(lines[0]))]
        out = ["|".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in lines]
        if self.names:
            out.insert(1, "+".join("-" * w for w in widths))
        return "\n".join(out) + "\n"


def _text(value: Any) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)
