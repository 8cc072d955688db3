"""Mergeable sketches as binary columns: HyperLogLog for distinct counts, and a quantile sketch of relative error.

Both are sparse tables of slots. Building one is an aggregation by slot, so it is combined in each task before rows are shuffled and no key's rows meet in one task; merging sketches is the same
over their slots. A sketch is binary: the number of slots (unsigned, 32 bits), their numbers (32 bits each, ascending), their values (64 bits each), little-endian.

Nulls are in no sketch; a key whose values are all null has a sketch without slots, which estimates 0 or null. An empty table gives no sketches. Merging is associative and commutative, and
sketches of the same rows are the same bytes, however the rows were split.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a hash that choose a register: 4,096 registers, a standard error of 1.6 %.
PRECISION = 12
#: Most relative error of a quantile.
ERROR = 0.01


@F.pandas_udf(T.BinaryType())
def _packed(slots: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([np.uint32(len(s)).tobytes() + np.asarray(s, "<i4").tobytes() + np.asarray(v, "<i8").tobytes() for s, v in zip(slots, values, strict=True)])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return np.frombuffer(data, "<i4", n, 4), np.frombuffer(data, "<i8", n, 4 + 4 * n)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("value", T.LongType())])))
def _unpacked(sketch: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [{"slot": int(a), "value": int(b)} for a, b in zip(*_unpack(x), strict=True)] for x in sketch])


def _sketch(rows: DataFrame, keys: Sequence[str], how: str, name: str) -> DataFrame:
    """``rows``: keys, _slot (null: nothing to count) and _value."""
    whole = F.max if how == "max" else F.sum
    slots = rows.groupBy(*keys, "_slot").agg(whole("_value").alias("_value"))
    listed = F.array_sort(F.collect_list(F.when(F.col("_slot").isNotNull(), F.struct("_slot", "_value"))))
    out = slots.groupBy(*keys).agg(listed.alias("_all"))
    return out.select(*keys, _packed(F.transform("_all", lambda x: x["_slot"]), F.transform("_all", lambda x: x["_value"])).alias(name))


def merged(df: DataFrame, keys: Sequence[str], sketch: str, how: str, name: str | None = None) -> DataFrame:
    """One sketch for each key of all its sketches; ``how`` is max for HyperLogLog and sum for quantiles."""
    if how not in ("max", "sum"):
        raise ValueError("sketches are merged by max or sum")
    rows = df.select(*keys, F.explode_outer(_unpacked(sketch)).alias("_s")).select(*keys, F.col("_s.slot").alias("_slot"), F.col("_s.value").alias("_value"))
    return _sketch(rows, keys, how, name or sketch)


# --- distinct counts


def distinct_sketch(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "sketch", precision: int = PRECISION) -> DataFrame:
    """Rows (keys, sketch): HyperLogLog registers of the values as strings. A register's value is the place of the first set bit in 32 further bits of an MD5."""
    if not 4 <= precision <= 16:
        raise ValueError("a precision is from 4 to 16 bits")
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    digest = F.md5(text.cast("binary"))
    head, tail = (F.conv(F.substring(digest, a, n), 16, 10).cast("long") for a, n in ((1, 4), (5, 8)))
    rank = F.when(tail == 0, 33).otherwise(33 - F.char_length(F.bin(tail)))
    rows = df.select(*keys, F.shiftright(head, 16 - precision).cast("int").alias("_slot"), rank.cast("long").alias("_value"))
    return _sketch(rows, keys, "max", name)


def distinct_estimate(sketch: str | Column, precision: int = PRECISION) -> Column:
    """The number of different values, a whole number; by linear counting as long as many registers are empty."""
    m = 1 << precision
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))

    @F.pandas_udf("long")
    def estimate(sketch: pd.Series) -> pd.Series:
        out = []
        for x in sketch:
            if x is None:
                out.append(None)
                continue
            _, ranks = _unpack(x)
            empty = m - len(ranks)
            raw = alpha * m * m / (empty + float(np.exp2(-ranks.astype(float)).sum()))
            out.append(math.floor((m * math.log(m / empty) if raw <= 2.5 * m and empty else raw) + 0.5))
        return pd.Series(out, dtype="Int64")

    return estimate(sketch)


# --- quantiles


def quantile_sketch(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "sketch", error: float = ERROR) -> DataFrame:
    """Rows (keys, sketch): counts of values by powers of ``(1 + error) / (1 - error)``, positive and negative ones apart. Values that aren't numbers, or infinite, raise."""
    if not 0 < error < 1:
        raise ValueError("an error is between 0 and 1")
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("a value isn't a finite number")).cast("double")).otherwise(x)
    power = F.ceil(F.log(F.abs(x)) / F.lit(math.log((1 + error) / (1 - error)))).cast("int")
    # powers are shifted so that positive and negative values have slots of their own, in the order of values; 0 has slot 0
    slot = F.when(x == 0, 0).when(x > 0, power + SHIFT).when(x < 0, -(power + SHIFT))
    return _sketch(df.select(*keys, slot.cast("int").alias("_slot"), F.lit(1).cast("long").alias("_value")), keys, "sum", name)


#: More than the largest power of a double at an error of a millionth.
SHIFT = 1 << 30


def quantile(sketch: str | Column, q: float, error: float = ERROR) -> Column:
    """The value of rank ``floor(q * (n - 1))`` among a sketch's n values, off by ``error`` of itself at the most; null where there are none."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile is from 0 to 1")
    gamma = (1 + error) / (1 - error)

    @F.pandas_udf("double")
    def at(sketch: pd.Series) -> pd.Series:
        out = []
        for x in sketch:
            slots, counts = _unpack(x) if x is not None else ((), ())
            if not len(slots):
                out.append(None)
                continue
            ends = np.cumsum(counts)
            k = int(slots[np.searchsorted(ends, math.floor(q * (int(ends[-1]) - 1)), "right")])
            out.append(0.0 if k == 0 else math.copysign(2 * gamma ** (abs(k) - SHIFT) / (gamma + 1), k))
        return pd.Series(out, dtype="Float64")

    return at(sketch)
