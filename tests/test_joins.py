import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins as J
from millrace.operators.layout import cleanup


def plain_asof(left, right, direction, equal):
    """``left``: (k, t, id); ``right``: (k, t, v); by loops."""
    out = []
    for k, t, i in left:
        best = None
        for rk, rt, v in right:
            if None in (k, t, rk, rt) or rk != k:
                continue
            ok = (rt <= t if equal else rt < t) if direction == "backward" else (rt >= t if equal else rt > t)
            near = rt if direction == "backward" else -rt
            if ok and (best is None or (near, v) > best[0]):
                best = (near, v), (rk, rt, v)
        out.append((k, t, i, *(best[1] if best else (None, None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("equal", [True, False])
@pytest.mark.parametrize("parts", [1, 9])
def test_asof_equals_loops(spark, direction, equal, parts):
    rng = random.Random(f"{direction}{equal}")
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "é", None])
    time = lambda: rng.choice([None, *range(30)])
    left = [(key(), time(), i) for i in range(300)] + [("hot", 7, 0), ("hot", 7, 0), ("only left", 1, 5)]
    right = [(key(), time(), i) for i in range(80)] + [("only right", 1, 5)]
    x = spark.createDataFrame(left, "k string, t int, id int").repartition(3)
    y = spark.createDataFrame(right, "k string, t int, v int").repartition(2)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = J.asof_join(x, y, ["k"], "t", "t", tie="v", direction=direction, allow_equal=equal, prefix="r_")
        assert out.columns == ["k", "t", "id", "r_k", "r_t", "r_v"]
        got = sorted(map(tuple, out.collect()), key=repr)
        assert out.rdd.getNumPartitions() == parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        cleanup(spark)
    assert got == plain_asof(left, right, direction, equal)


def test_asof_one_key_is_spread(spark):
    n = 20_000
    x = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.map_from_arrays(F.array(F.lit("a")), F.array("id")).alias("m"))
    y = spark.range(0, n, 1000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.array("id").alias("v"))
    out = J.asof_join(x, y, ["k"], "t", "at", prefix="r_")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * n
    assert out.where("r_v[0] != t div 1000 * 1000 or r_at is null or m['a'] != t").count() == 0
    cleanup(spark)


def test_asof_edges(spark):
    x = spark.createDataFrame([("a", 1.5)], "k string, t double")
    y = spark.createDataFrame([("a", 1, "v"), ("a", 1, "w")], "k string, t int, v string")
    assert [tuple(r) for r in J.asof_join(x, y.where("false"), ["k"], "t", "t", prefix="r_").collect()] == [("a", 1.5, None, None, None)]
    assert J.asof_join(x.where("false"), y, ["k"], "t", "t", prefix="r_").collect() == []
    assert [r["r_v"] for r in J.asof_join(x, y, ["k"], "t", "t", tie="v", prefix="r_").collect()] == ["w"]
    assert [r["r_v"] for r in J.asof_join(x, y, ["k"], "t", "t", tie="v", prefix="r_", within=lambda a, b: a - b < 0.5).collect()] == [None]
    with pytest.raises(ValueError, match="prefix"):
        J.asof_join(x, y, ["k"], "t", "t")
    with pytest.raises(ValueError, match="direction"):
        J.asof_join(x, y, ["k"], "t", "t", direction="up")
    cleanup(spark)


def plain_overlaps(left, right, closed):
    out = []
    for k, a, b, i in left:
        for rk, c, d, j in right:
            if None in (k, a, b, rk, c, d) or k != rk:
                continue
            if closed and a <= b and c <= d and a <= d and c <= b or not closed and a < b and c < d and a < d and c < b:
                out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("dense", [J.DENSE, 3])
def test_intervals_equal_loops(spark, closed, dense):
    rng = random.Random(dense)

    def made(n):
        rows = []
        for i in range(n):
            a, length = rng.randrange(-200, 200), rng.choice([0, 0, 1, 2, 3, 7, 8, 9, 100, 5000, -1])
            rows.append((rng.choice(["x", "x", "y", None]), rng.choice([a, a, a, a, None]), a + length, i))
        return [*rows, ("x", -(1 << 40), 1 << 40, n), ("y", 5, None, n + 1)]

    left, right = made(70), made(60)
    x, y = (spark.createDataFrame(r, "k string, a long, b long, id int") for r in (left, right))
    out = J.interval_join(x, y, ("a", "b"), ("a", "b"), on=["k"], closed=closed, prefix="r_", dense=dense)
    assert sorted((r["id"], r["r_id"]) for r in out.collect()) == plain_overlaps(left, right, closed)


def test_repeated_rows_and_times(spark):
    x = spark.sql("select timestamp '2024-01-01 00:00:00' as a, timestamp '2024-01-02 00:00:00' as b, 1 as v from range(3)")
    y = spark.sql("select date '2024-01-02' as d, 2 as w from range(2)")
    assert J.interval_join(x, y, ("a", "b"), ("d", "d")).count() == 6
    assert J.interval_join(x, y.where("false"), ("a", "b"), ("d", "d")).count() == 0
    with pytest.raises(TypeError):
        J.interval_join(x, y.selectExpr("1.5 as d"), ("a", "b"), ("d", "d"))


def test_a_dense_bucket_is_spread(spark):
    """One interval over everything, and all others in the buckets where it lies: pieces keep tasks small."""
    n = 4000
    x = spark.range(n).select(F.col("id").alias("a"), F.col("id").alias("b"))
    y = spark.createDataFrame([(0, n, "wide")], "c long, d long, name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.interval_join(x, y, ("a", "b"), ("c", "d"), dense=20)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and len(sizes) == 4 and max(sizes) < 0.45 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
