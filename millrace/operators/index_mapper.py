"""Dictionary encoding: a bijection of values and 0-based indexes in the order of first insertion."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.layout import numbered


class IndexMapper:
    """A table (value, idx). Look-ups are joins, which Spark broadcasts where the table is small enough by its statistics."""

    def __init__(self, table: DataFrame):
        self.table = table

    @staticmethod
    def of(spark: SparkSession, values: Iterable[Any], kind: str = "string") -> IndexMapper:
        """From host values; one that repeats raises."""
        values = list(values)
        if len(set(values)) != len(values):
            raise ValueError("values repeat")
        return IndexMapper(spark.createDataFrame(list(zip(values, range(len(values)), strict=True)), f"value {kind}, idx long"))

    @staticmethod
    def unique(df: DataFrame, value: str, order: Sequence[str | Column] | str) -> IndexMapper:
        """The distinct values of a column in the order in which they first appear."""
        order = [order] if isinstance(order, str) else list(order)
        first = df.groupBy(F.col(value).alias("value")).agg(F.min(F.struct(*order)).alias("_first"))
        return IndexMapper(numbered(first, ["_first"], "idx").select("value", "idx"))

    def size(self) -> int:
        return self.table.count()

    def values(self) -> list:
        return [r["value"] for r in self.table.orderBy("idx").collect()]

    def contains(self, value: Any) -> bool:
        return not self.table.where(F.col("value").eqNullSafe(F.lit(value))).isEmpty()

    def index_for(self, value: Any, default: int | None = None) -> int:
        found = self.table.where(F.col("value").eqNullSafe(F.lit(value))).head()
        if found is None and default is None:
            raise KeyError(value)
        return default if found is None else found["idx"]

    def at(self, index: int) -> Any:
        found = self.table.where(F.col("idx") == index).head()
        if found is None:
            raise IndexError(index)
        return found["value"]

    def encode(self, df: DataFrame, column: str, to: str, default: int | None = None) -> DataFrame:
        """Adds the index of each value; one that isn't there gets ``default`` or raises."""
        t = self.table.select(F.col("value").alias("_value"), F.col("idx").alias("_idx"))
        missing = F.raise_error(F.concat(F.lit("no index for "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("long") if default is None else F.lit(default).cast("long")
        return df.join(t, F.col(column).eqNullSafe(F.col("_value")), "left").withColumn(to, F.coalesce("_idx", missing)).drop("_value", "_idx")

    def decode(self, df: DataFrame, column: str, to: str) -> DataFrame:
        """Adds the value of each index; one that isn't there raises."""
        t = self.table.select(F.col("value").alias("_value"), F.col("idx").alias("_idx"), F.lit(True).alias("_there"))
        kind = self.table.schema["value"].dataType
        missing = F.raise_error(F.concat(F.lit("no value for index "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast(kind)
        return df.join(t, F.col(column) == F.col("_idx"), "left").withColumn(to, F.when(F.col("_there"), F.col("_value")).otherwise(missing)).drop("_value", "_idx", "_there")

    def encode_array(self, df: DataFrame, key: str, column: str, to: str, default: int | None = None) -> DataFrame:
        """Adds the indexes of the elements of an array column; ``key`` must be unique."""
        kind = df.schema[column].dataType
        if not isinstance(kind, T.ArrayType):
            raise TypeError(f"{column} is no array")
        rows = self.encode(df.select(key, F.posexplode(column).alias("_i", "_v")), "_v", "_x", default)
        lists = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda r: r["_x"]).alias(to))
        return df.join(lists, key, "left").withColumn(to, F.coalesce(to, F.array().cast("array<long>")))

    def insert(self, *values: Any) -> IndexMapper:
        """Appends values; one that is there raises."""
        have = {r["value"] for r in self.table.where(F.col("value").isin(list(values))).collect()}
        if have or len(set(values)) != len(values):
            raise ValueError("values repeat")
        return self._appended(list(values))

    def try_insert(self, *values: Any) -> tuple[IndexMapper, list[bool]]:
        """Appends the values that aren't there; also tells for each whether it is new."""
        have = {r["value"] for r in self.table.where(F.col("value").isin(list(values))).collect()}
        new, flags = [], []
        for v in values:
            flags.append(v not in have)
            if v not in have:
                have.add(v)
                new.append(v)
        return (self._appended(new) if new else self), flags

    def _appended(self, values: list) -> IndexMapper:
        n = self.table.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("n")).first()["n"]
        kind = self.table.schema["value"].dataType.simpleString()
        more = self.table.sparkSession.createDataFrame([(v, n + i) for i, v in enumerate(values)], f"value {kind}, idx long")
        return IndexMapper(self.table.unionAll(more))
