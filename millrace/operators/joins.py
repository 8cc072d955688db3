"""Joins on order and on intervals: as-of joins, and joins of overlapping intervals (range joins are those with points)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.layout import fixed

#: Rows of one side that a bucket of intervals has before it is cut.
DENSE = 200_000


def _checked(left: DataFrame, right: DataFrame, prefix: str) -> None:
    both = {c.lower() for c in left.columns} & {f"{prefix}{c}".lower() for c in right.columns}
    if both:
        raise ValueError(f"both sides have columns {sorted(both)}; give a prefix for the right one's")


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, tie: str | None = None, direction: str = "backward", allow_equal: bool = True,
    within: Callable[[Column, Column], Column] | None = None, right_by: Sequence[str] | None = None, prefix: str = "",
) -> DataFrame:
    """Every row of ``left`` with the row of ``right`` that is last before it (backward) or first after it (forward) among those with equal ``by``; without one, nulls.

    Both sides lie in one sequence by key and time, cut into ranges, so a key's rows may lie in many tasks. A task walks through its range and keeps the last row of the right side;
    what it begins with is the last one of the ranges before, which a table of one row for each range tells. There is no window and no list of a key's rows.

    ``tie``: of right rows of one key and time, the one with the greatest value of this column counts; without it, the one with the greatest hash. ``allow_equal``: rows of the same time count.
    ``within``: a condition on both times that a match must meet. Columns of ``right`` get ``prefix``; names that clash raise. Null keys and times match nothing; such rows of ``left`` stay.
    Rows of ``left`` that repeat are matched each. An empty right side gives nulls.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("a direction is backward or forward")
    _checked(left, right, prefix)
    by, right_by = list(by), list(right_by or by)
    if not by:
        raise ValueError("give a key; a column that is the same everywhere will do")
    up = direction == "backward"
    keys = [f"_k{i}" for i in range(len(by))]
    kinds = {k: left.schema[c].dataType for k, c in zip(keys, by, strict=True)}
    time = left.schema[left_time].dataType
    left_row, right_row = left.schema, T.StructType([T.StructField(f"{prefix}{f.name}", f.dataType) for f in right.schema])
    none = F.lit(None)

    def side(df: DataFrame, on: Sequence[str], at: str, is_right: bool) -> DataFrame:
        row = F.struct(*(df[c].alias(f.name) for c, f in zip(df.columns, (right_row if is_right else left_row).fields, strict=True)))
        there = F.lit(True)
        for c in [*on, at]:
            there = there & df[c].isNotNull()
        # at the same time, right rows come first if they count; rows of one time may lie in several ranges, left ones by a hash, right ones by the tie
        first = is_right == allow_equal
        return df.select(
            *(df[c].cast(kinds[k]).alias(k) for k, c in zip(keys, on, strict=True)), df[at].cast(time).alias("_t"), F.lit(0 if first else 1).alias("_side"),
            (df[tie] if is_right and tie else none.cast(right.schema[tie].dataType if tie else "int")).alias("_tie"), _mix(df).alias("_mix"),
            F.lit(is_right).alias("_right"), there.alias("_there"), (none.cast(left_row) if is_right else row).alias("_l"), (row if is_right else none.cast(right_row)).alias("_r"),
        )

    rows = side(left, by, left_time, False).unionByName(side(right, right_by, right_time, True).where("_there"))
    order = [*keys, F.asc("_t") if up else F.desc("_t"), "_side", "_tie", "_mix"]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fixed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))

    out_names = [f.name for f in [*left_row.fields, *right_row.fields]]
    n_left, n_right = len(left_row.fields), len(right_row.fields)

    def walked(batches: Iterator[pa.RecordBatch], begin: pa.Array | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray, pa.Array | None]]:
        """Each batch, where its right rows are, the pool of right rows, each row's place in it (negative: none), and the right row that goes on after the batch."""
        kept, before = begin, None
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            is_right, found = np.asarray(batch.column("_right")), batch.column("_r")
            new = np.zeros(m, bool)  # another key than the row before
            for k in keys:
                c = batch.column(k)
                new[1:] |= ~np.asarray(pc.fill_null(pc.equal(c.slice(1), c.slice(0, m - 1)), False))
                new[0] |= before is not None and not (before[k].is_valid and c[0].is_valid and before[k].as_py() == c[0].as_py())
            # place 0 is the row that was kept, if it is of the same key
            there = kept is not None and not new[0]
            pool = pa.concat_arrays([kept if there else pa.nulls(1, found.type), found])
            at = np.arange(1, m + 1)
            base = np.maximum.accumulate(np.where(new, at, 0))
            last = np.maximum.accumulate(np.where(is_right, at, 0))
            last = np.where((last >= base) & ((last > 0) | there), last, -1)
            kept, before = pool.slice(int(last[-1]), 1) if last[-1] >= 0 else None, {k: batch.column(k)[m - 1] for k in keys}
            yield batch, is_right, pool, last, kept

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each range: its first and last keys, whether they are one, and the last right row of the last key."""
        first = last = kept = None
        one = True
        for batch, _, _, _, kept in walked(batches, None):  # noqa: B007
            key = batch.select(keys)
            first = _key(key, 0) if first is None else first
            last = _key(key, batch.num_rows - 1)
        if first is not None:
            one = first == last
            row = None if kept is None else _bytes(pa.RecordBatch.from_arrays([kept], ["row"]))
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "first": [first], "last": [last], "one": [one], "row": [row]}, _ENDS)

    carried: dict[int, bytes] = {}
    key, row = None, None
    got = rows.select(*keys, "_right", "_r").mapInArrow(ends, "part int, first binary, last binary, one boolean, row binary").collect()
    for r in sorted(got, key=lambda r: r["part"]):
        if row is not None and r["first"] == key:
            carried[r["part"]] = row
        row = r["row"] if r["row"] is not None or not (r["one"] and r["first"] == key) else row
        key = r["last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = carried.get(TaskContext.get().partitionId())
        begin = None if begin is None else pa.ipc.open_stream(begin).read_next_batch().column(0)
        for batch, is_right, pool, last, _ in walked(batches, begin):
            take = np.where(np.asarray(batch.column("_there")), last, -1)[~is_right]
            mine = batch.column("_l").filter(pa.array(~is_right))
            if len(mine):
                match = pool.take(pa.array(np.maximum(take, 0), mask=take < 0))
                yield pa.RecordBatch.from_arrays([*_fields(mine, n_left), *_fields(match, n_right)], out_names)

    out = rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in [*left_row.fields, *right_row.fields]]))
    if within is not None:
        mine = [f.name for f in right_row.fields]
        ok = within(F.col(left_time), F.col(f"{prefix}{right_time}"))
        out = out.select(*left.columns, *(F.when(ok, F.col(c)).alias(c) for c in mine))
    return out


def _mix(df: DataFrame) -> Column:
    """A hash of a row; maps have none."""
    return F.xxhash64(*(df[f.name] for f in df.schema.fields if "map<" not in f.dataType.simpleString()))


_ENDS = pa.schema([("part", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("one", pa.bool_()), ("row", pa.binary())])


def _bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _key(keys: pa.RecordBatch, i: int) -> bytes:
    """A row's keys; the same bytes for equal keys, whatever batch they were in."""
    return _bytes(pa.RecordBatch.from_arrays([pa.array([c[i].as_py()], c.type) for c in keys.columns], keys.schema.names))


def _fields(rows: pa.StructArray, n: int) -> list[pa.Array]:
    """The fields of structs; null where the struct is null."""
    return [pc.struct_field(rows, [i]) for i in range(n)]


def interval_join(
    left: DataFrame, right: DataFrame, left_interval: tuple[Any, Any], right_interval: tuple[Any, Any], on: Sequence[str] = (), right_on: Sequence[str] | None = None, closed: bool = True, prefix: str = "", dense: int = DENSE,
) -> DataFrame:
    """All pairs of rows whose intervals overlap (a point is an interval with two equal ends), and whose values ``on`` are equal.

    Intervals are pairs of columns of whole numbers, or of times (microseconds then). ``closed``: ends belong to the interval; else the upper end doesn't, and an empty interval overlaps nothing.
    An interval has a level, the power of two that isn't shorter than it; at a level it lies in one or two buckets of that width, whatever its length. A pair meets at the higher one of
    its levels, in the first bucket that both have: the longer interval lies there, the shorter one looks there. So a row is copied twice for each level above its own that the other side has, 64 at the
    most, and a wide interval isn't cut in many pieces. A bucket that has over ``dense`` rows of a side is cut by a hash of the rows (those that are equal in all columns stay together), the other side's rows there are copied to each piece.
    Rows with a null end or key, or whose end is before its start, are in no pair. Columns of ``right`` get ``prefix``; names that clash raise.
    """
    _checked(left, right, prefix)
    on, right_on = list(on), list(right_on or on)
    kinds = {f"_k{i}": left.schema[c].dataType for i, c in enumerate(on)}

    def side(df: DataFrame, keys: Sequence[str], interval: tuple[Any, Any], names: Sequence[str]) -> DataFrame:
        a, b = (_whole(df, x) for x in interval)
        row = F.struct(*(df[c].alias(n) for c, n in zip(df.columns, names, strict=True))) if df.columns else F.struct(F.lit(0))
        out = df.select(*(df[c].cast(kind).alias(k) for (k, kind), c in zip(kinds.items(), keys, strict=True)), a.alias("_a"), (b if closed else b - 1).alias("_b"), row.alias("_row"), _mix(df).alias("_mix"))
        for c in [*kinds, "_a", "_b"]:
            out = out.where(F.col(c).isNotNull())
        # the least level whose width isn't less than the length
        length = F.col("_b") - F.col("_a") + 1
        return out.where("_b >= _a").withColumn("_own", F.char_length(F.bin(length - 1)).cast("int") * (length > 1).cast("int"))

    one, two = side(left, on, left_interval, left.columns), side(right, right_on, right_interval, [f"{prefix}{c}" for c in right.columns])
    levels = {name: [r["_own"] for r in df.select("_own").distinct().collect()] for name, df in (("l", one), ("r", two))}  # 64 at the most

    def placed(df: DataFrame, others: list[int]) -> DataFrame:
        """A row for each level where the other side's longer intervals lie, and for the row's own; and there for each bucket."""
        looks = F.filter(F.array(*(F.lit(x) for x in sorted(others))).cast("array<int>"), lambda x: x > F.col("_own"))
        out = df.withColumn("_level", F.explode(F.array_union(F.array("_own"), looks)))
        low, high = (F.expr(f"shiftright({c}, _level)") for c in ("_a", "_b"))
        return out.withColumn("_first", low).withColumn("_bucket", F.explode(F.sequence(low, high)))

    one, two = placed(one, levels["r"]), placed(two, levels["l"])
    cell = [*kinds, "_level", "_bucket"]
    one, two = _cut(one, two, cell, dense)
    meet = (F.col("l._a") <= F.col("r._b")) & (F.col("r._a") <= F.col("l._b")) & (F.col("l._bucket") == F.greatest("l._first", "r._first"))
    same = F.lit(True)
    for c in [*cell, "_p", "_q"]:
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    # one of the two is at its own level, and the other one's isn't higher: so each pair has one level
    out = one.alias("l").join(two.alias("r"), same & meet & (F.greatest("l._own", "r._own") == F.col("l._level")))
    return out.select("l._row.*", "r._row.*")


def _whole(df: DataFrame, column: Any) -> Column:
    c = df[column] if isinstance(column, str) else column
    kind = df.select(c).schema[0].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp"))
    if not isinstance(kind, T.IntegralType):
        raise TypeError("ends of intervals are whole numbers or times")
    return c.cast("long")


def _cut(one: DataFrame, two: DataFrame, cell: list[str], dense: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of dense cells: _p parts the first side's rows, _q the second's; each side has a copy for every piece of the other one."""
    count = lambda df, name: df.groupBy(*cell).agg(F.count("*").alias(name)).where(F.col(name) > dense).select(*cell, F.ceil(F.col(name) / dense).cast("int").alias(name))
    ps, qs = count(one, "_np"), count(two, "_nq")
    full = ps.join(qs, cell, "full").na.fill(1, ["_np", "_nq"])

    def dealt(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        df = df.join(full, cell, "left").na.fill(1, ["_np", "_nq"])
        own_piece = F.pmod(F.col("_mix"), F.col(n_own)).cast("int")
        return df.withColumn(own, own_piece).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("_np", "_nq")

    return dealt(one, "_p", "_np", "_q", "_nq"), dealt(two, "_q", "_nq", "_p", "_np")
