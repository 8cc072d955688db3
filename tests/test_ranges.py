import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import sketches as K
from millrace.operators import ranges as R
from millrace.operators.layout import cleanup


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, *range(40)])) for i in range(500)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, i int, v int").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("before,after,piece", [(0, 0, 1), (3, 2, 7), (40, 0, 5), (0, 9, 50), (1000, 1000, 10)])
def test_rows_frame(spark, df, rows, before, after, piece):
    got = {r["i"]: (r["s"], r["n"]) for r in R.rows_frame(df, ["k"], ["i"], before, after, {"s": F.sum("v"), "n": F.count("*")}, piece=piece).collect()}
    for group in by_key(rows).values():
        for j, r in enumerate(group):
            frame = group[max(0, j - before) : j + after + 1]
            values = [x[2] for x in frame if x[2] is not None]
            assert got[r[1]] == (sum(values) if values else None, len(frame))
    assert len(got) == len(rows)
    cleanup(spark)


@pytest.mark.parametrize("before,after", [(0, 0), (3, 1), (100, 100)])
def test_range_frame(df, rows, before, after):
    got = {r["i"]: r["n"] for r in R.range_frame(df, ["k"], "v", before, after, {"n": F.count("*")}).collect()}
    for k, i, v in rows:
        assert got[i] == sum(1 for a, _, w in rows if a == k and (v is None and w is None or None not in (v, w) and v - before <= w <= v + after))


@pytest.mark.parametrize("parts", [1, 9])
def test_running(spark, df, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["i"]: (r["s"], r["place"]) for r in R.running(df, ["k"], ["i"], {"s": F.col("v")}, "place").collect()}
        one = {r["i"]: r["place"] for r in R.running(df, [], ["i"], {}, "place").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for group in by_key(rows).values():
        total = None
        for j, (_, i, v) in enumerate(group):
            total = total if v is None else (total or 0) + v
            assert got[i] == (total, j + 1)
    assert one == {i: i + 1 for i in range(len(rows))}
    assert R.running(df.where("false"), ["k"], ["i"], {"s": F.col("v")}).collect() == []
    cleanup(spark)


@pytest.mark.parametrize("k,held", [(1, 3), (5, 40), (1000, 10**6)])
def test_top_k(df, rows, k, held):
    got = sorted(map(tuple, R.top_k(df, ["k"], [("v", "descending"), ("i", "ascending")], k, held=held).collect()), key=repr)
    want = []
    for group in by_key(rows).values():
        group.sort(key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        want += [(*r, j + 1) for j, r in enumerate(group[:k])]
    assert got == sorted(want, key=repr)
    assert R.top_k(df.where("false"), ["k"], [("v", "descending")], k).collect() == []
    with pytest.raises(ValueError):
        R.top_k(df, ["k"], [("v", "descending")], 0)


def test_multisets(spark):
    rng = random.Random(1)
    x, y = ([(rng.choice(["a", None]), rng.choice([1, 2, None])) for _ in range(n)] + [("hot", 0)] * h for n, h in ((40, 700), (30, 300)))
    a, b = spark.createDataFrame(x, "p string, q int"), spark.createDataFrame(y, "r string, s int")
    rows = lambda d: Counter(map(tuple, d.collect()))
    assert rows(R.intersect_all(a, b)) == Counter(x) & Counter(y) and rows(R.except_all(a, b)) == Counter(x) - Counter(y)
    assert rows(R.except_all(a, b.where("false"))) == Counter(x) and not rows(R.intersect_all(a.where("false"), b))
    with pytest.raises(ValueError):
        R.except_all(a, b.select("r"))


def test_grouping_sets_tell_totals_from_nulls(spark):
    d = spark.createDataFrame([("a", None, 1), ("a", "x", 1), (None, None, 2)], "p string, q string, v int")
    got = {tuple(r) for r in R.grouping_sets(d, [["p", "q"], ["p"], []], [F.count("*").alias("n"), F.count_distinct("v").alias("d")]).collect()}
    assert got == {("a", None, 0, 1, 1), ("a", "x", 0, 1, 1), (None, None, 0, 1, 1), ("a", None, 1, 2, 1), (None, None, 1, 1, 1), (None, None, 3, 3, 2)}
    assert R.rollup_sets(["a", "b"]) == [["a", "b"], ["a"], []] and sorted(R.cube_sets(["a", "b"])) == [[], ["a"], ["a", "b"], ["b"]]


def test_distinct_sketches(spark):
    for n in (0, 1, 50, 3000, 100_000):
        d = spark.range(2 * n).select((F.col("id") % 3).alias("part"), (F.col("id") % n if n else F.col("id")).alias("v")).unionByName(spark.sql("select 0L as part, cast(null as bigint) as v"))
        parts = K.distinct_sketch(d, ["part"], "v")
        whole, once = K.merged(parts, [], "sketch", "max"), K.distinct_sketch(d, [], "v")
        assert whole.first()["sketch"] == once.first()["sketch"]  # the same bytes, however rows were split
        (got,) = whole.select(K.distinct_estimate("sketch").alias("n")).first()
        assert abs(got - n) <= 4 * 1.04 / math.sqrt(1 << K.PRECISION) * n
    assert K.distinct_sketch(spark.range(0), ["id"], "id").collect() == []


def test_quantile_sketches(spark):
    rng = random.Random(6)
    values = [rng.choice([-1, 1, 1]) * math.exp(rng.gauss(0, 6)) for _ in range(5000)] + [0.0] * 50 + [1e-300, -1e300, None]
    d = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "part int, v double")
    whole = K.merged(K.quantile_sketch(d, ["part"], "v"), [], "sketch", "sum")
    assert whole.first()["sketch"] == K.quantile_sketch(d, [], "v").first()["sketch"]
    ordered = sorted(v for v in values if v is not None)
    for q in (0, 0.01, 0.3, 0.5, 0.9, 0.999, 1):
        (got,) = whole.select(K.quantile("sketch", q)).first()
        want = ordered[math.floor(q * (len(ordered) - 1))]
        assert abs(got - want) <= 1.000001 * K.ERROR * abs(want)
    assert K.quantile_sketch(d.where("v is null"), [], "v").select(K.quantile("sketch", 0.5)).first()[0] is None
    with pytest.raises(Exception, match="finite"):
        K.quantile_sketch(spark.sql("select double('nan') as v"), [], "v").collect()


def test_interval_sums(spark):
    """Against loops: equal places, keys that repeat, empty and backward intervals, nulls, values near the limits of 64 bits."""
    rng = random.Random(3)
    big = (1 << 63) - 1
    points = [(rng.choice([None, *range(-20, 20)]), rng.choice([None, 0, 1, -5])) for _ in range(300)] + [(30 + i, big) for i in range(5)] + [(40, None)]
    windows = [(rng.choice([None, "a", "b", *map(str, range(40))]), rng.choice([None, *range(-25, 25)]), rng.choice([None, *range(-25, 25)])) for _ in range(200)]
    windows += [("one", 34, 35), ("none", 40, 41), ("empty", 100, 200)]
    want = {}
    for k, a, b in windows:
        for at, v in points:
            if None not in (a, b, at) and a <= at < b:
                n, s = want.get(k, (0, None))
                want[k] = n + 1, s if v is None else (s or 0) + v
    w, p = spark.createDataFrame(windows, "k string, a long, b long").repartition(3), spark.createDataFrame(points, "at long, v long").repartition(3)
    got = R.interval_sums(w, p, "k", ("a", "b"), "at", {"s": "v"}).collect()
    assert {r["k"]: (r["n"], r["s"]) for r in got} == want and len(got) == len(want) and want["one"] == (1, big) and want["none"] == (1, None)
    assert R.interval_sums(w.limit(0), p, "k", ("a", "b"), "at", {"s": "v"}).collect() == [] == R.interval_sums(w, p.limit(0), "k", ("a", "b"), "at", {}).collect()
    # ten billion pairs at one place
    many = spark.range(100_000).selectExpr("id", "7L as a", "8L as b")
    got = R.interval_sums(many, many, "id", ("a", "b"), "a", {"s": "id"}).agg(F.count("*"), F.min("n"), F.max("s"), F.min("s")).first()
    assert tuple(got) == (100_000, 100_000, 4_999_950_000, 4_999_950_000)
    cleanup(spark)


def test_range_events_errors_makes_no_pairs(spark, tmp_path):
    """Very many errors and events in one hour."""
    from millrace.plans.relational import range_events_errors

    spark.range(60_000).selectExpr("id as event_id", "timestamp_seconds(id % 100) as ts", "0L as user_id", "'error' as event_type", "0D as value", "'' as props").write.parquet(str(tmp_path / "events.parquet"))
    got = range_events_errors(spark, str(tmp_path))
    assert got.columns == ["error_id", "n", "ids"] and got.agg(F.count("*"), F.sum("n"), F.sum("ids")).first()[:2] == (60_000, 600 * 600 * 100 * 101 // 2)
    cleanup(spark)
