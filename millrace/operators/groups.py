"""Random groups of exact sizes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.random import bits
from millrace.operators.layout import REPEATED, SMALL, is_small, numbered
from millrace.operators.layout import fixed as kept


def group_sizes(n: int, ratio: Sequence[float]) -> list[int]:
    """Exact sizes: each the rounded share (halves up), the last group with a positive ratio takes the rest; sizes never run over ``n``."""
    if not ratio or any(r < 0 for r in ratio) or sum(ratio) <= 0:
        raise ValueError("ratios must not be negative, and one must be positive")
    kept = max(i for i, r in enumerate(ratio) if r > 0)
    out, left = [], n
    for r in ratio[:kept]:
        size = min(left, math.floor(r / sum(ratio) * n + 0.5))
        out.append(size)
        left -= size
    return [*out, left, *[0] * (len(ratio) - kept - 1)]


def _group(rank: Column, sizes: Sequence[int]) -> Column:
    out, at = F.lit(len(sizes) - 1), sum(sizes)
    for g in reversed(range(len(sizes))):
        at -= sizes[g]
        if sizes[g]:
            out = F.when(rank >= at, F.lit(g)).otherwise(out) if out is None else F.when((rank >= at) & (rank < at + sizes[g]), F.lit(g)).otherwise(out)
    return out.cast("int")


def _ends(sizes: Sequence[int]) -> dict[int, int]:
    """Of groups with rows, the rank after the last one."""
    return {g: sum(sizes[: g + 1]) for g in range(len(sizes)) if sizes[g]}


def _literal(value: Any, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)))
    if isinstance(kind, T.ArrayType) and value is not None:
        return F.array(*(_literal(v, kind.elementType) for v in value)).cast(kind)
    return F.lit(value).cast(kind)


def _cuts(rows: DataFrame, hashes: Sequence[Column], key: str, ranks: Sequence[int]) -> list[dict[int, Column]]:
    """For each of several orders by (hash of 32 bits, key), for each rank: whether a row comes before the one that has this rank.

    The rows are counted by their hashes' upper 16 bits, then those at a cut by the lower ones; both counts have a fixed size for each order. Only where rows of one hash lie on both
    sides of a cut (of 2**32 rows each hash has about one) do keys decide. Nothing is sorted, and all orders go in one pass.
    """
    if not ranks or not hashes:
        return [{} for _ in hashes]
    each = rows.select(F.col(key).alias("_key"), F.posexplode(F.array(*hashes)).alias("_k", "_hash"))
    upper = F.shiftright("_hash", 16)

    def at_ranks(counts: DataFrame, by: list[str], order: str, first: Column) -> list:
        """Of counts, in each order, those where the ranks lie, with the number of rows before them: a row for each order and rank at the most."""
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", first + F.coalesce(F.sum("_n").over(before), F.lit(0)))
        return counts.where(F.exists(F.array(*(F.lit(r).cast("long") for r in ranks)), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))).collect()

    wide = at_ranks(each.groupBy("_k", upper.alias("_upper")).agg(F.count("*").alias("_n")), ["_k"], "_upper", F.lit(0))
    places = rows.sparkSession.createDataFrame([(r["_k"], r["_upper"], r["_before"]) for r in wide], "_k int, _upper long, _first long")
    near = each.withColumn("_upper", upper).join(F.broadcast(places), ["_k", "_upper"])
    fine = at_ranks(near.groupBy("_k", "_upper", "_first", "_hash").agg(F.count("*").alias("_n")), ["_k", "_upper"], "_hash", F.col("_first"))
    kind, out = rows.schema[key].dataType, []
    for k, h in enumerate(hashes):
        found = {}
        for r in ranks:
            c = next((c for c in fine if c["_k"] == k and c["_before"] <= r < c["_before"] + c["_n"]), None)
            found[r] = F.lit(True) if c is None else h < c["_hash"]  # or there are no more rows
            if c is None:
                continue
            if c["_before"] < r:
                same = each.where((F.col("_k") == k) & (F.col("_hash") == c["_hash"])).orderBy("_key").limit(r - c["_before"] + 1).collect()[-1]["_key"]  # a row for each 2**32
                found[r] = found[r] | (h == c["_hash"]) & (F.col(key).isNull() | (F.col(key) < _literal(same, kind)))
        out.append(found)
    return out


def _by_cuts(cuts: dict[int, Column], sizes: Sequence[int]) -> Column:
    """The group of a row: the first one that it comes before the end of."""
    out = F.lit(len(sizes) - 1)
    for g, end in reversed(_ends(sizes).items()):
        out = F.when(cuts[end], F.lit(g)).otherwise(out)
    return out.cast("int")


def _unique(rows: DataFrame, key: str) -> None:
    if not rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        raise ValueError(REPEATED)


def generate_groups(df: DataFrame, ratio: Sequence[float], key: str, seed: int = 0, name: str = "group", n: int | None = None, small: int = SMALL) -> DataFrame:
    """Adds a random group to every row; each group has exactly its share of rows.

    ``key`` must be unique, at any size (a repeated one raises, null is a key too): rows are ranked by hashes of it and the seed, so the result doesn't depend on partitioning.
    A larger input is written once to the shared folder (``layout.cleanup`` deletes it) and not sorted: the places in the order where groups begin are sought by counts.
    """
    if is_small(df, small):
        sizes = group_sizes(df.count() if n is None else n, ratio)
        ranked = numbered(df, [bits(seed, F.col(key)), F.col(key)], "_rank", small)
        return ranked.withColumn(name, _group(F.col("_rank"), sizes)).drop("_rank")
    rows = kept(df)
    sizes = group_sizes(rows.count() if n is None else n, ratio)
    _unique(rows, key)
    return rows.withColumn(name, _by_cuts(_cuts(rows, [bits(seed, F.col(key))], key, [*_ends(sizes).values()])[0], sizes))


def generate_many(df: DataFrame, n: int, volatile: Sequence[float], fixed: Sequence[float], key: str, seed: int = 0, name: str = "group", small: int = SMALL) -> DataFrame:
    """Adds ``n`` groupings (name_0, ...): rows of the fixed groups have the same group in all of them, the others are dealt anew to the volatile groups each time."""
    v = len(volatile)
    if not is_small(df, small):
        rows = kept(df)
        sizes = group_sizes(rows.count(), [*volatile, *fixed])
        _unique(rows, key)
        group = _by_cuts(_cuts(rows, [bits(seed, F.col(key))], key, [*_ends(sizes).values()])[0], sizes)
        moving = group_sizes(sum(sizes[:v]), volatile) if any(sizes[:v]) else [0]
        cuts = _cuts(rows.where(group < v), [bits(f"{seed}:{k}", F.col(key)) for k in range(n)], key, [*_ends(moving).values()])
        rows = rows.withColumn("_base", group)
        return rows.select(*df.columns, *(F.when(F.col("_base") < v, _by_cuts(c, moving)).otherwise(F.col("_base")).cast("int").alias(f"{name}_{k}") for k, c in enumerate(cuts)))
    base = generate_groups(df, [*volatile, *fixed], key, seed, "_base", small=small)
    sizes = group_sizes(df.count(), [*volatile, *fixed])
    moving = sum(sizes[:v])
    out = base
    for k in range(n):
        # the rows of volatile groups come first, so their positions are their ranks among themselves
        ranked = numbered(out, [(F.col("_base") >= v).cast("int"), bits(f"{seed}:{k}", F.col(key)), F.col(key)], "_rank", small)
        again = _group(F.col("_rank"), group_sizes(moving, volatile)) if moving else F.lit(0)
        out = ranked.withColumn(f"{name}_{k}", F.when(F.col("_base") < v, again).otherwise(F.col("_base")).cast("int")).drop("_rank")
    return out.drop("_base")
