"""Stream operators as table functions of SQL, over a table argument that the query parts and orders.

    register(spark)
    SELECT * FROM create_batches(TABLE(orders) PARTITION BY o_custkey ORDER BY (o_orderkey), 8)
    SELECT * FROM pad_batches(TABLE(turns) PARTITION BY batch ORDER BY (place), 'words')
    SELECT * FROM unpack_elements(TABLE(turns), 'words')

Each partition of the table argument is a stream of its own, so a query's partitions spread over tasks. ``create_batches`` and ``unpack_elements`` hold a row at a time, ``pad_batches`` a batch:
part its table by batch. Null arrays have no elements; an empty table gives no rows; a column that is missing, or whose name the function gives out, raises when the query is analysed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _table(argument: AnalyzeArgument, new: list[str]) -> T.StructType:
    if not isinstance(argument.dataType, T.StructType) or not argument.isTable:
        raise ValueError("the first argument is a table")
    both = {n.lower() for n in new} & {f.name.lower() for f in argument.dataType.fields}
    if both:
        raise ValueError(f"the table has columns {sorted(both)} already")
    return argument.dataType


def _array(table: T.StructType, argument: AnalyzeArgument) -> T.StructField:
    found = next((f for f in table.fields if f.name == argument.value), None)
    if found is None or not isinstance(found.dataType, T.ArrayType):
        raise ValueError(f"there is no column of arrays called {argument.value}")
    return found


class CreateBatches:
    """The table's columns with ``batch`` and ``place``: rows of the partition in batches of a size, the last one smaller."""

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        kind = _table(table, ["batch", "place"])
        if not isinstance(size.value, int) or size.value <= 0:
            raise ValueError("batches must have a positive size")
        return AnalyzeResult(T.StructType([T.StructField("batch", T.LongType()), T.StructField("place", T.LongType()), *kind.fields]))

    def __init__(self):
        self.n = 0

    def eval(self, row: Row, size: int) -> Iterator[tuple]:
        yield (self.n // size, self.n % size, *row)
        self.n += 1


class PadBatches:
    """The table's columns with arrays of a column filled up with nulls to the longest one of the partition, and ``mask``: which elements were there."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        kind = _table(table, ["mask"])
        _array(kind, column)
        fields = [T.StructField(f.name, T.ArrayType(f.dataType.elementType) if f.name == column.value else f.dataType) for f in kind.fields]
        return AnalyzeResult(T.StructType([*fields, T.StructField("mask", T.ArrayType(T.BooleanType()))]))

    def __init__(self):
        self.rows: list[Row] = []
        self.column = ""

    def eval(self, row: Row, column: str) -> None:
        self.rows.append(row)
        self.column = column

    def terminate(self) -> Iterator[tuple]:
        longest = max((len(r[self.column] or ()) for r in self.rows), default=0)
        for r in self.rows:
            values = list(r[self.column] or ())
            left = longest - len(values)
            filled: dict[str, Any] = {**r.asDict(), self.column: values + [None] * left}
            yield (*(filled[c] for c in r.__fields__), [True] * len(values) + [False] * left)


class UnpackElements:
    """The table's columns without the arrays of a column, with ``i`` and ``element``: a row for each of their elements."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        kind = _table(table, ["i", "element"])
        array = _array(kind, column)
        rest = [f for f in kind.fields if f.name != column.value]
        return AnalyzeResult(T.StructType([*rest, T.StructField("i", T.IntegerType()), T.StructField("element", array.dataType.elementType)]))

    def eval(self, row: Row, column: str) -> Iterator[tuple]:
        rest = tuple(row[c] for c in row.__fields__ if c != column)
        for i, x in enumerate(row[column] or ()):
            yield (*rest, i, x)


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    for name, function in (("create_batches", CreateBatches), ("pad_batches", PadBatches), ("unpack_elements", UnpackElements)):
        spark.udtf.register(name, udtf(function))
