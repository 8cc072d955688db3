"""Windows, tops and multisets without a task that has all rows of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.layout import fixed, numbered

#: Rows of a piece of a key's sequence; rows that a task of ``top_k`` holds before it drops what can't be in a top.
PIECE, HELD = 50_000, 100_000
_AT, _HOME, _PIECE = "_at", "_home", "_piece"


def rows_frame(df: DataFrame, by: Sequence[str], order: Sequence[str], before: int, after: int, aggregates: dict[str, Column], piece: int = PIECE) -> DataFrame:
    """``df`` with aggregates over each row's frame: the ``before`` rows ahead of it to the ``after`` rows behind it in the order, among rows of equal ``by``.

    The rows are numbered by (by, order), which must be unique together, and cut into pieces of ``piece`` rows; a piece also has the rows of its neighbours that its frames reach, so a key with all
    rows lies in many pieces. Null keys are a key. An empty table stays empty; columns _at, _home and _piece are taken.
    """
    if min(before, after) < 0:
        raise ValueError("a frame reaches 0 rows or more to either side")
    piece = max(piece, before + after + 1)
    rows = numbered(df, [*by, *order], _AT)
    home = F.floor(F.col(_AT) / piece)
    reach = F.sequence(F.floor((F.greatest(F.col(_AT) - after, F.lit(0))) / piece), F.floor((F.col(_AT) + before) / piece))
    rows = rows.withColumn(_HOME, home).withColumn(_PIECE, F.explode(reach))
    frame = Window.partitionBy(_PIECE, *by).orderBy(_AT).rowsBetween(-before, after)
    return rows.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items())).where(F.col(_HOME) == F.col(_PIECE)).drop(_AT, _HOME, _PIECE)


def range_frame(df: DataFrame, by: Sequence[str], on: str | Column, before: int, after: int, aggregates: dict[str, Column], width: int | None = None) -> DataFrame:
    """``df`` with aggregates over the rows of equal ``by`` whose whole number ``on`` is from ``before`` less than the row's to ``after`` more.

    A key is cut at multiples of ``width`` (the frame's length, if it isn't given); a piece also has what its frames reach of the pieces beside it. Rows whose number is null have
    frames of the other nulls. A single number with very many rows stays in one task, as its frames all are the same rows.
    """
    if min(before, after) < 0:
        raise ValueError("a frame reaches 0 or more to either side")
    width = max(width or 0, before + after + 1)
    at = (F.col(on) if isinstance(on, str) else on).cast("long")
    rows = df.withColumn(_AT, at)
    home = F.floor(F.col(_AT) / width)
    reach = F.when(F.col(_AT).isNotNull(), F.sequence(F.floor((F.col(_AT) - after) / width), F.floor((F.col(_AT) + before) / width))).otherwise(F.array(F.lit(None).cast("long")))
    rows = rows.withColumn(_HOME, home).withColumn(_PIECE, F.explode(reach))
    frame = Window.partitionBy(_PIECE, *by).orderBy(_AT).rangeBetween(-before, after)
    return rows.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items())).where(F.col(_HOME).eqNullSafe(F.col(_PIECE))).drop(_AT, _HOME, _PIECE)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column], number: str | None = None) -> DataFrame:
    """``df`` with sums that run on over the rows of equal ``by`` up to each row, and with ``number`` the row's place from 1.

    The rows lie in ranges of (by, order), which must be unique together; each range sums by itself, and adds what the ranges before have of its first key: a table of a row for each range.
    Null values add nothing, and a sum without any value is null, as in SQL.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    keys = F.struct(*(F.col(c) for c in by)) if by else F.lit(0)
    rows = fixed(df.withColumns(values).withColumn("_key", keys).repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_part", F.spark_partition_id()))
    totals = [F.sum(v).alias(v) for v in values]
    each = rows.groupBy("_part", "_key").agg(F.count("*").alias("_n"), *totals)
    # keys that go over the end of a range are few: only these are added up over ranges
    ends = rows.groupBy("_part").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"))
    over = ends.select(F.explode(F.array("lo", "hi")).alias("_key"), "_part").distinct()
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.join(over, ["_part", "_key"], "left_semi").select("_part", "_key", F.sum("_n").over(earlier).alias("_n"), *(F.sum(v).over(earlier).alias(f"{v}_0") for v in values))
    inside = Window.partitionBy("_part", "_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select("*", F.row_number().over(inside).alias("_i"), *(F.sum(v).over(inside).alias(f"{v}_1") for v in values))
    match = (F.col("c._part") == F.col("r._part")) & F.col("c._key").eqNullSafe(F.col("r._key"))
    out = out.alias("r").join(F.broadcast(carried.alias("c")), match, "left")  # two rows for each range at the most
    both = lambda v: F.when(F.col(f"{v}_0").isNull(), F.col(f"{v}_1")).otherwise(F.col(f"{v}_0") + F.coalesce(F.col(f"{v}_1"), F.lit(0)))
    place = [(F.coalesce("c._n", F.lit(0)) + F.col("_i")).cast("long").alias(number)] if number else []
    return out.select(*(F.col(f"r.{c}") for c in df.columns), *(both(v).alias(name) for v, name in zip(values, sums, strict=True)), *place)


def interval_sums(windows: DataFrame, points: DataFrame, key: str, interval: tuple[str, str], at: str, sums: dict[str, str], number: str = "n") -> DataFrame:
    """For each ``key`` of ``windows`` that has any, how many of the ``points`` lie in its intervals, from the first end up to but without the second, and the sums of columns of whole numbers over them.

    As from a join, but without its pairs: points are counted and summed by place, these run on over all places, and an interval has what its second end has more than its first. So the work is that of
    sorting the rows, however many points intervals hold. Null points, intervals with a null end and those whose end isn't after their start have nothing; rows of one key are added up; null values add
    nothing, and a sum without any value is null.
    """
    names = {f"_s{i}": c for i, c in enumerate(sums.values())}
    whole, none = "decimal(38,0)", F.lit(None)  # sums over all places may need more than 64 bits where an interval's doesn't
    counted = {"_n": F.count("*"), **{c: F.sum(F.col(v).cast(whole)).cast(whole) for c, v in names.items()}, **{f"{c}n": F.count(v) for c, v in names.items()}}
    places = points.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("long").alias("_place")).agg(*(c.alias(n) for n, c in counted.items()))
    low, high = (F.col(c).cast("long") for c in interval)
    ends = F.explode(F.array(F.struct(low.alias("_place"), F.lit(-1).alias("_sign")), F.struct(high.alias("_place"), F.lit(1).alias("_sign"))))
    edges = windows.where(low < high).select(F.col(key).alias("_key_"), ends.alias("_e")).select("_e._place", "_e._sign", "_key_")
    # at one place the ends come first: the second one doesn't belong to an interval, the first one does
    both = places.select("_place", F.lit(0).alias("_sign"), none.cast(windows.schema[key].dataType).alias("_key_"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_mix"), *counted)
    both = both.unionByName(edges.select("*", F.lit(0).alias("_side"), F.xxhash64("_key_", "_sign").alias("_mix"), *(none.cast(places.schema[c].dataType).alias(c) for c in counted)))
    rows = running(both, [], ["_place", "_side", "_mix"], {f"{c}r": F.col(c) for c in counted}).where("_side = 0")
    rows = rows.groupBy(F.col("_key_").alias(key)).agg(*(F.sum(F.coalesce(F.col(f"{c}r"), F.lit(0)).cast(whole) * F.col("_sign")).alias(c) for c in counted)).where("_n > 0")
    return rows.select(key, F.col("_n").cast("long").alias(number), *(F.when(F.col(f"{c}n") > 0, F.col(c)).cast("long").alias(name) for c, name in zip(names, sums, strict=True)))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, str]], k: int, rank: str = "rank", held: int = HELD) -> DataFrame:
    """The first ``k`` rows of each group, with their places from 1. ``order``: columns, each with ``ascending`` or ``descending``; nulls come last. Together with ``by`` they must tell rows apart, or ties are cut anywhere.

    A task keeps the best ``k`` rows of each group that it has seen, and gives them out when it holds over ``held``; what all tasks give is cut again by group. No input is sorted as a whole, and
    a group's rows never meet, only its tasks' tops.
    """
    if k <= 0:
        raise ValueError("a top has rows")
    by, keys = list(by), [*((c, "ascending") for c in by), *order]
    fields = df.schema.fields

    def best(t: pa.Table) -> pa.Table:
        at = pc.sort_indices(t, sort_keys=keys, null_placement="at_end")
        t = t.take(at)
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in by:
            x = t[c].combine_chunks()
            x = (x.dictionary_encode(null_encoding="encode") if not pa.types.is_nested(x.type) else pa.array(list(map(str, x.to_pylist()))).dictionary_encode()).indices
            new[1:] |= np.asarray(x)[1:] != np.asarray(x)[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(t.num_rows), 0))
        place = np.arange(t.num_rows) - first
        return t.append_column(rank, pa.array(place + 1, pa.int64())).filter(pa.array(place < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n > held:
                t = best(pa.concat_tables(kept)).drop_columns([rank])
                if t.num_rows > held // 2:  # as many groups as that: the rest is for the next step
                    yield from t.to_batches()
                    t = t.slice(0, 0)
                kept, n = [t], t.num_rows
        if n:
            yield from best(pa.concat_tables(kept)).drop_columns([rank]).to_batches()

    tops = df.mapInArrow(run, df.schema)
    ordered = Window.partitionBy(*by).orderBy(*(F.col(c).asc_nulls_last() if way == "ascending" else F.col(c).desc_nulls_last() for c, way in order))
    return tops.withColumn(rank, F.row_number().over(ordered).cast("long")).where(F.col(rank) <= k).select(*(f.name for f in fields), rank)


def multiset(left: DataFrame, right: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows as often as ``keep`` says from how often each side has them: both sides' rows are counted together, in each task first, so there is no join and a hot row is a number.

    Sides have the same number of columns, taken by place; nulls are equal to each other.
    """
    if len(left.columns) != len(right.columns):
        raise ValueError("both sides need the same number of columns")
    both = left.select("*", F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(right.select("*", F.lit(0), F.lit(1)))
    counts = both.groupBy(*left.columns).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    times = F.greatest(keep(F.col("_l"), F.col("_r")), F.lit(0))
    return counts.withColumn("_n", times).where("_n > 0").select(*left.columns, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_i")).drop("_i")


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return multiset(left, right, F.least)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return multiset(left, right, lambda a, b: a - b)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column], level: str = "level") -> DataFrame:
    """Aggregates for several groupings in one pass: columns of all sets (null in rows of sets without them), ``level``, aggregates.

    ``level`` has a bit for each column of all sets in their order, the first one highest: set where the row's set is without the column. So a total can be told from a group whose key is null.
    Several distinct counts go with it; Spark expands rows for these too, and combines them in tasks.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    bits = F.lit(0).cast("long")
    for c in names:
        bits = bits * 2 + F.grouping(c).cast("long")
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(bits.alias(level), *aggregates)
    return out.select(*names, level, *(c for c in out.columns if c not in names and c != level))


def rollup_sets(columns: Sequence[str]) -> list[list[str]]:
    return [list(columns[:n]) for n in range(len(columns), -1, -1)]


def cube_sets(columns: Sequence[str]) -> list[list[str]]:
    return [[c for i, c in enumerate(columns) if not k >> i & 1] for k in range(1 << len(columns))]
