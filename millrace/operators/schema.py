"""Declared columns and streams of host batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from millrace.functions.ndim import ndims
from millrace.operators.layout import BATCH
from millrace.operators.stream import Stream


@dataclass(frozen=True)
class ColumnDef:
    """A column's name and the type of one example."""

    name: str
    kind: T.DataType

    @staticmethod
    def of(name: str, kind: str) -> ColumnDef:
        return ColumnDef(name, T._parse_datatype_string(kind))

    def dimensions(self) -> int:
        """Dimensions of a batch of it: examples, and the levels below."""
        return 1 + ndims(self.kind)


def row_type(columns: Sequence[ColumnDef]) -> T.StructType:
    """The type of a row of these columns; names must differ."""
    if len({c.name.lower() for c in columns}) != len(columns):
        raise ValueError("column names must differ")
    return T.StructType([T.StructField(c.name, c.kind) for c in columns])


def host_stream(spark: SparkSession, columns: Sequence[ColumnDef], batches: Sequence[dict[str, Sequence[Any]]]) -> Stream:
    """A stream of batches on the host; a batch that lacks a column has no examples of it."""
    row_type(columns)
    kind = T.StructType([T.StructField(BATCH, T.LongType()), *(T.StructField(c.name, T.ArrayType(c.kind)) for c in columns)])
    return Stream.from_batches(spark.createDataFrame([(i, *(list(b.get(c.name, [])) for c in columns)) for i, b in enumerate(batches)], kind))
