import sys
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace.operators.layout import BATCH, cumulated, numbered
from millrace.operators.pyfun import CHAR, PyFun
from millrace.operators.stream import Stream
from millrace.sources.sinks import buffered

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def rows(spark, n=10, size=3, **columns):
    s = Stream.create(spark.range(n).withColumnRenamed("id", "k").repartition(4), "k", size)
    for name, value in columns.items():
        s = s.insert_or_assign(name, value)
    return s


def nested(spark):
    return Stream.from_batches(spark.createDataFrame([(0, [[1, 2], []]), (1, [[3], [4, 5, 6]]), (2, [])], f"{BATCH} long, v array<array<int>>"))


def test_plain_function_at_dim_1(spark):
    s = rows(spark).transform("k", "square", PyFun(lambda k: k * k, "long"))
    assert s.unpack("square") == [k * k for k in range(10)]
    two = rows(spark).transform(["k", "k"], ["a", "b"], PyFun(lambda x, y: (x + y, (x - y).astype(str)), ["long", "string"]))
    assert two.unpack(["a", "b"]) == ([2 * k for k in range(10)], ["0"] * 10)
    with pytest.raises(Exception, match="elements"):
        rows(spark).transform("k", "k", PyFun(lambda k: k[:1], "long")).df.collect()


@pytest.mark.parametrize("dim, want", [(1, [[3, 0], [3, 15], []]), (2, [[[10, 20], []], [[30], [40, 50, 60]], []]), (0, [2, 2, 0])])
def test_every_dimension(spark, dim, want):
    fun = {0: PyFun(lambda b: b.map(len), "int"), 1: PyFun(lambda e: e.map(lambda x: int(np.sum(x))), "int"), 2: PyFun(lambda x: x * 10, "int")}[dim]
    assert nested(spark).transform("v", "out", fun, dim=dim).unpack("out", 0) == want


def test_characters(spark):
    s = rows(spark, 3, 2, t=F.element_at(F.array(*map(F.lit, ["añ🎉", "", "xyz"])), (F.col("k") + 1).cast("int")))
    assert s.transform("t", "up", PyFun(lambda c: c.str.upper(), CHAR), dim=2).unpack("up") == ["AÑ🎉", "", "XYZ"]
    assert s.transform("t", "n", PyFun(lambda c: c.map(ord), "int"), dim=2).unpack("n") == [[97, 241, 127881], [], [120, 121, 122]]


def test_condition_and_probability(spark):
    s = rows(spark, 40, 7, even=F.col("k") % 2 == 0, v=F.col("k"))
    seen = s.transform("v", "v", PyFun(lambda v: -v, "long"), cond="even").unpack("v")
    assert seen == [-k if k % 2 == 0 else k for k in range(40)]
    a = s.transform("v", "v", PyFun(lambda v: -v, "long"), prob=0.5, seed=3).unpack("v")
    assert a == s.transform("v", "v", lambda v: -v, prob=0.5, seed=3).unpack("v") and len({x < 0 for x in a}) == 2
    arrays = rows(spark, 6, 2, v=F.sequence(F.lit(0).cast("long"), F.col("k")), c=F.transform(F.sequence(F.lit(0).cast("long"), F.col("k")), lambda x: x % 2 == 1))
    assert arrays.transform("v", "v", PyFun(lambda v: v + 100, "long"), dim=2, cond="c").unpack("v")[3] == [0, 101, 2, 103]


class Counter:
    """Adds how many elements it has seen before."""

    def __init__(self):
        self.n = 0

    def __call__(self, x: pd.Series) -> pd.Series:
        out = x + np.arange(self.n, self.n + len(x))
        self.n += len(x)
        return out


def test_state_runs_over_batches_in_order(spark):
    s = rows(spark, 1000, 7).transform("k", "n", PyFun(Counter, "long", stateful=True))
    assert s.unpack("n") == [2 * k for k in range(1000)]
    flat = nested(spark).transform("v", "v", PyFun(Counter, "int", stateful=True), dim=2)
    assert flat.unpack("v", 0) == [[[1, 3], []], [[5], [7, 9, 11]], []]
    some = rows(spark, 20, 3, odd=F.col("k") % 2 == 1, v=F.lit(0).cast("long")).transform("v", "v", PyFun(Counter, "long", stateful=True), cond="odd")
    assert some.unpack("v") == [k // 2 if k % 2 else 0 for k in range(20)]


def test_state_by_a_column(spark):
    s = rows(spark, 200, 9, g=(F.col("k") % 3).cast("string"), v=F.lit(0).cast("long")).transform("v", "v", PyFun(Counter, "long", stateful=True, by="g"))
    assert s.unpack("v") == [k // 3 for k in range(200)]


def every_third():
    n = 0

    def keep(x: pd.Series) -> pd.Series:
        nonlocal n
        out = pd.Series((np.arange(n, n + len(x)) % 3) == 0)
        n += len(x)
        return out

    return keep


def test_filter(spark):
    s = rows(spark, 20, 4, v=F.col("k") * 2)
    kept = s.filter(["k", "v"], "v", PyFun(lambda v: v % 4 == 0, "boolean"))
    assert kept.columns == ["k", "v"] and kept.unpack("k") == list(range(0, 20, 2))
    assert s.filter(["k", "v"], "k", PyFun(every_third, "boolean", stateful=True)).unpack("k") == list(range(0, 20, 3))
    part = s.filter("v", "v", PyFun(lambda v: v > 10, "boolean"))
    assert part.unpack("k", 0) == s.unpack("k", 0) and part.unpack("v", 0)[0] == []
    assert nested(spark).filter("v", "v", PyFun(lambda x: x % 2 == 0, "boolean"), dim=2).unpack("v", 0) == [[[2], []], [[], [4, 6]], []]
    assert nested(spark).filter([], "v", PyFun(lambda b: b.map(lambda x: len(x) > 0), "boolean"), dim=0).unpack("v", 0) == [[[1, 2], []], [[3], [4, 5, 6]]]


def counting():
    n = 0

    def give(m: int) -> np.ndarray:
        nonlocal n
        n += m
        return np.arange(n - m, n)

    return give


def test_generate(spark):
    fun = PyFun(counting, "long", stateful=True)
    assert rows(spark, 10, 3).generate("k", "g", fun).unpack("g") == list(range(10))
    s = nested(spark)
    assert s.generate("v", "g", fun, depth=1).unpack("g", 0) == [[[0, 1], []], [[2], [3, 4, 5]], []]
    assert s.generate("v", "g", fun, depth=1, fresh=0).unpack("g", 0) == [[[0, 0], []], [[2], [3, 3, 3]], []]
    assert rows(spark, 5, 2).generate("k", "g", PyFun(lambda n: ["x"] * n, "string")).unpack("g") == ["x"] * 5


def test_several_strings_at_their_characters(spark):
    words = ["abc", "", "xyz", "é🎉"]
    s = rows(spark, 4, 2, t=F.element_at(F.array(*map(F.lit, words)), (F.col("k") + 1).cast("int"))).copy("t", "u").transform("u", "u", lambda c: F.upper(c), dim=2)
    assert s.transform(["t", "u"], "t", lambda a, b: F.concat(a, b), dim=2).unpack("t") == ["aAbBcC", "", "xXyYzZ", "éÉ🎉🎉"]
    assert s.transform("t", "n", lambda c: F.ascii(c), dim=2).unpack("n")[0] == [97, 98, 99]
    assert s.transform(["t", "u"], ["t", "u"], lambda a, b: (b, a), dim=2).unpack(["t", "u"]) == ([w.upper() for w in words], words)
    c = s.transform("t", "c", lambda c: c != "b", dim=2)
    assert c.transform("t", "t", lambda c: F.upper(c), dim=2, cond="c").unpack("t") == ["AbC", "", "XYZ", "É🎉"]
    assert s.transform("t", "t", lambda c: F.lit("_"), dim=2, prob=1.0).unpack("t") == ["___", "", "___", "__"]
    half = s.transform("t", "t", lambda c: F.lit("_"), dim=2, prob=0.5, seed=1)
    assert all(len(a) == len(b) and all(x in ("_", y) for x, y in zip(a, b, strict=True)) for a, b in zip(half.unpack("t"), words, strict=True))
    assert s.filter(["t", "u"], ["t"], lambda c: c != "b", dim=2).unpack(["t", "u"]) == (["ac", "", "xyz", "é🎉"], ["AC", "", "XYZ", "É🎉"])


def test_columns_are_set_at_once(spark):
    """Several columns that take one another's old values, below the examples."""
    s = rows(spark, 3, 2, a=F.sequence(F.lit(0).cast("long"), F.col("k")), b=F.transform(F.sequence(F.lit(0).cast("long"), F.col("k")), lambda x: x + 10))
    a, b = s.transform(["a", "b"], ["a", "b"], lambda x, y: (y, x), dim=2).unpack(["a", "b"])
    assert a == [[10], [10, 11], [10, 11, 12]] and b == [[0], [0, 1], [0, 1, 2]]
    a, b = s.filter(["a", "b"], ["a"], lambda x: x != 1, dim=2).unpack(["a", "b"])
    assert a == [[0], [0], [0, 2]] and b == [[10], [10], [10, 12]]
    a, b = s.filter(["a", "b"], ["a", "b"], lambda x, y: x + y != 12, dim=2).unpack(["a", "b"])
    assert a == [[0], [0], [0, 2]] and b == [[10], [10], [10, 12]]
    deep = rows(spark, 2, 2, a=F.array(F.sequence(F.lit(0).cast("long"), F.col("k")), F.array(F.col("k"))))
    deep = deep.transform("a", "b", lambda x: x * 2, dim=3)
    a, b = deep.transform(["a", "b"], ["a", "b"], lambda x, y: (y + 1, x), dim=3).unpack(["a", "b"])
    assert a == [[[1], [1]], [[1, 3], [3]]] and b == [[[0], [0]], [[0, 1], [1]]]
    half = s.transform(["a", "b"], ["a", "b"], lambda x, y: (y, x), dim=2, prob=0.5, seed=4).unpack(["a", "b"])
    assert all(sorted((x, y)) == [i, i + 10] for p, q in zip(*half, strict=True) for i, (x, y) in enumerate(zip(p, q, strict=True)))
    padded = rows(spark, 3, 3, a=F.array(F.sequence(F.lit(0).cast("long"), F.col("k")), F.array(F.col("k")))).pad("a", "m", F.lit(-1), depth=2)
    a, m = padded.unpack(["a", "m"])
    assert [[[x >= 0 for x in r] for r in e] for e in a] == m and {len(r) for e in a for r in e} == {3}


@pytest.mark.parametrize("small", [1 << 40, 0])
def test_order_must_be_unique(spark, small):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "a int, b int").repartition(5)
    assert [r["p"] for r in numbered(df, ["a", F.col("b").desc()], "p", small).orderBy("a", F.col("b").desc()).collect()] == list(range(50))
    with pytest.raises(Exception, match="repeat"):
        numbered(df, ["a"], "p", small).collect()
    got = cumulated(df, ["a", "b"], F.col("b").cast("long"), "s", small).orderBy("a", "b").collect()
    assert [r["s"] for r in got] == [sum(x["b"] for x in got[:i]) for i in range(50)]


def test_buffer_is_ahead_of_the_reader(spark):
    made = []

    def slow():
        for i in range(20):
            made.append(i)
            yield i

    it = buffered(slow(), 3)
    assert next(it) == 0
    time.sleep(0.5)
    assert 4 <= len(made) <= 5  # three ready, one in hand
    assert list(it) == list(range(1, 20))
    s = rows(spark, 10, 3)
    dicts = list(s.buffer(2).transform("k", "k", lambda k: k + 1).to_python())
    assert [d["k"].tolist() for d in dicts] == [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10]]
    with pytest.raises(ValueError):
        s.buffer(0)


def test_buffer_passes_errors_and_stops():
    def broken():
        yield 1
        raise KeyError("x")

    it = buffered(broken(), 1)
    assert next(it) == 1
    with pytest.raises(KeyError):
        next(it)
    before = threading.active_count()
    it = buffered(iter(range(10**9)), 2)
    next(it)
    it.close()
    time.sleep(0.5)
    assert threading.active_count() <= before
