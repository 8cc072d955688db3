import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators.layout import cleanup
from millrace.operators.pyfun import PyFun, Scan
from millrace.operators.stream import Stream

M = 1_000_003


def affine() -> Scan:
    """Each element is a map v -> (3 v + x) mod M; a state is the map of all before it, a result what it makes of 1. Associative, but not commutative."""
    m = M

    def partial(x):
        a, b = 1, 0
        for v in x:
            a, b = 3 * a % m, (3 * b + int(v)) % m
        return a, b

    def results(state, x):
        a, b = state
        out = []
        for v in x:
            a, b = 3 * a % m, (3 * b + int(v)) % m
            out.append((a + b) % m)
        return pd.Series(out, dtype="int64")

    return Scan((1, 0), partial, lambda p, q: (q[0] * p[0] % m, (q[0] * p[1] + q[1]) % m), results)


AFFINE = affine()


def in_loops(values):
    out, v = [], 1
    for x in values:
        v = (3 * v + x) % M
        out.append(v)
    return out


def rows(spark, n, parts, **columns):
    return Stream.create(spark.range(n).withColumnRenamed("id", "k").withColumns({"v": F.pmod(F.xxhash64("k"), F.lit(1000)), **columns}).repartition(parts), "k", 4)


@pytest.fixture(autouse=True)
def parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    cleanup(spark)


@pytest.mark.parametrize("n", [0, 1, 5, 2000])
def test_equals_a_loop(spark, n):
    s = rows(spark, n, 3)
    out = s.transform("v", "w", PyFun(AFFINE, "long", stateful=True))
    assert out.unpack("w") == in_loops(s.unpack("v"))


def test_no_task_has_all_rows(spark):
    out = rows(spark, 5000, 3).transform("v", "w", PyFun(AFFINE, "long", stateful=True)).df
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 7 and max(sizes) < 2500


def test_by_a_column_with_a_hot_value(spark):
    key = F.when(F.col("k") % 10 < 7, F.lit("hot")).when(F.col("k") % 10 == 7, F.lit(None)).otherwise((F.col("k") % 40).cast("string"))
    s = rows(spark, 3000, 5, g=key)
    got = s.transform("v", "w", PyFun(AFFINE, "long", stateful=True, by="g"))
    by = {}
    for g, v, w in zip(got.unpack("g"), got.unpack("v"), got.unpack("w"), strict=True):
        by.setdefault(g, ([], []))[0].append(v)
        by[g][1].append(w)
    assert len(by) > 5 and all(w == in_loops(v) for v, w in by.values())
    assert got.df.where("g = 'hot'").select(F.spark_partition_id()).distinct().count() > 3


def test_deeper_and_conditional(spark):
    rng = random.Random(2)
    data = [(i, [rng.randrange(100) for _ in range(rng.randrange(4))] if i % 9 else None, bool(i % 2)) for i in range(200)]
    s = Stream.create(spark.createDataFrame(data, "k long, v array<long>, odd boolean").repartition(3), "k", 3)
    flat = s.transform("v", "v", PyFun(AFFINE, "long", stateful=True), dim=2)
    assert flat.df.where("v is not null").orderBy("k").selectExpr("inline(arrays_zip(v))").count() == sum(len(v or []) for _, v, _ in data)
    assert [x for r in flat.df.orderBy("k").collect() for x in r["v"] or []] == in_loops([x for _, v, _ in data for x in v or []])
    t = rows(spark, 300, 3, odd=F.col("k") % 2 == 1)
    some = t.transform("v", "v", PyFun(AFFINE, "long", stateful=True), cond="odd")
    old = t.unpack("v")
    new = iter(in_loops([v for i, v in enumerate(old) if i % 2]))
    assert some.unpack("v") == [next(new) if i % 2 else v for i, v in enumerate(old)]


def test_filter_and_generate(spark):
    third = Scan(0, len, lambda a, b: a + b, lambda n, x: pd.Series(np.arange(n, n + len(x)) % 3 == 0))
    s = rows(spark, 1000, 4)
    assert s.filter(s.columns, "k", PyFun(third, "boolean", stateful=True)).unpack("k") == list(range(0, 1000, 3))
    count = Scan(0, lambda m: m, lambda a, b: a + b, lambda n, m: np.arange(n, n + m))
    assert s.generate("k", "g", PyFun(count, "long", stateful=True)).unpack("g") == list(range(1000))


def test_a_scan_has_state():
    with pytest.raises(ValueError):
        PyFun(AFFINE, "long")
