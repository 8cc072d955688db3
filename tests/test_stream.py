import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.functions.threads import ThreadPool
from millrace.operators.layout import BATCH, numbered, zip_frames
from millrace.operators.schema import ColumnDef, host_stream
from millrace.operators.stream import Stream, identity


def stream(spark, sizes=None, **columns):
    """A stream in batch layout of host batches: column -> list of batches."""
    kinds = {"Int": "array<int>", "Double": "array<double>", "IntVec": "array<array<int>>", "IntVec1": "array<array<int>>", "IntVec2": "array<array<int>>", "Text": "array<string>", "Cube": "array<array<array<int>>>"}
    n = len(next(iter(columns.values())))
    return Stream.from_batches(spark.createDataFrame([(i, *(columns[c][i] for c in columns)) for i in range(n)], ", ".join([f"{BATCH} long", *(f"{c} {kinds[c]}" for c in columns)])))


def get(s, name):
    return s.unpack(name, 0)


@pytest.mark.parametrize("size, expected", [(1, [[i] for i in range(10)]), (50, [list(range(10))]), (5, [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]])])
def test_create(spark, size, expected):
    assert get(Stream.create(spark.range(10), "id", size), "id") == expected


def test_create_rejects(spark):
    with pytest.raises(ValueError):
        Stream.create(spark.range(3), "id", 0)


def test_flagship(spark):
    rows = list(zip(range(4), ["marry", "ted", "anna", "josh"], [24, 41, 16, 59], strict=True))
    s = Stream.create(spark.createDataFrame(rows, "k int, login string, age int"), "k", 2)
    s = s.transform("age", "age", lambda a: a + 1).transform("login", "login", lambda c: F.chr(F.ascii(c) + 1), dim=2)
    s = s.transform(["age", "login"], "age", lambda a, x: a + F.octet_length(x)).transform("login", "login", lambda x: F.lit("buck"), prob=0.5)
    s = s.drop("login").insert_or_assign("login", F.lit("x"))
    assert s.filter(s.columns, "age", lambda a: a > 30).buffer(2).unpack("age") == [45, 64]


def test_transform_both_layouts(spark):
    s = stream(spark, Int=[[2, 3], [1]], Double=[[4.0, 5.0], [2.0]])
    for t in (s, s.rows()):
        t = t.transform("Int", "Int", lambda x: x - 1).transform("Double", "Double", lambda x: x - 1)
        assert get(t, "Int") == [[1, 2], [0]] and get(t, "Double") == [[3.0, 4.0], [1.0]]


def test_transform_two_to_one_and_back(spark):
    s = stream(spark, Int=[[3, 7], [1, 2]], Double=[[5.0, 1.0], [3.0, 7.0]])
    assert get(s.transform(["Int", "Double"], "Double", lambda a, b: a + b), "Double") == [[8.0, 8.0], [4.0, 9.0]]
    t = s.transform("Int", ["Int", "Double"], lambda a: (a + a, (a * a).cast("double")))
    assert get(t, "Int") == [[6, 14], [2, 4]] and get(t, "Double") == [[9.0, 49.0], [1.0, 4.0]]


def test_transform_dim0_lets_lengths_differ(spark):
    s = stream(spark, Int=[[3, 7], [1, 2]], Double=[[2.0], [6.0]]).transform("Int", "Int", lambda a: F.array_append(a, F.lit(4)), dim=0)
    assert get(s, "Int") == [[3, 7, 4], [1, 2, 4]] and get(s, "Double") == [[2.0], [6.0]]
    with pytest.raises(Exception, match="different lengths"):
        s.rows().df.collect()


def test_transform_dim2_and_3(spark):
    s = stream(spark, IntVec=[[[6, 3], [7, 4], [2, 1]], [[2, 8]]])
    assert get(s.transform("IntVec", "IntVec", lambda x: x + 1, dim=2), "IntVec") == [[[7, 4], [8, 5], [3, 2]], [[3, 9]]]
    c = stream(spark, Cube=[[[[1], [2, 3]], []]])
    assert get(c.transform("Cube", "Cube", lambda x: x * 10, dim=3), "Cube") == [[[[10], [20, 30]], []]]


def test_transform_sizes_must_match(spark):
    s = stream(spark, IntVec1=[[[1, 2]]], IntVec2=[[[1]]]).transform(["IntVec1", "IntVec2"], "IntVec1", lambda a, b: a + b, dim=2)
    with pytest.raises(Exception, match="different sizes"):
        s.df.collect()


def test_conditional_and_probabilistic(spark):
    rows = [(i, d, c) for i, (d, c) in enumerate(zip([3, 1, 5, 7, 2, 13], [1, 1, 0, 0, 1, 0], strict=True))]
    s = Stream.create(spark.createDataFrame(rows, "k int, dogs int, go int"), "k", 3)
    assert get(s.transform("dogs", "dogs", lambda d: F.lit(-1), cond="go"), "dogs") == [[-1, -1, 5], [7, -1, 13]]
    big = Stream.create(spark.range(1000).withColumn("dogs", F.lit(0)), "id", 7)
    got = big.transform("dogs", "dogs", lambda d: F.lit(1), prob=1).transform("dogs", "dogs", lambda d: F.lit(2), prob=0.5, seed=3).transform("dogs", "dogs", lambda d: F.lit(3), prob=0)
    values = got.unpack("dogs")
    assert set(values) == {1, 2} and 430 < values.count(1) < 570
    again = Stream.create(spark.range(1000, numPartitions=7).withColumn("dogs", F.lit(0)), "id", 7).transform("dogs", "dogs", lambda d: F.lit(1), prob=1).transform("dogs", "dogs", lambda d: F.lit(2), prob=0.5, seed=3)
    assert again.unpack("dogs") == values
    with pytest.raises(KeyError):
        s.transform("dogs", "cats", lambda d: d, cond="go")


def test_filter_dim0(spark):
    s = stream(spark, Int=[[3, 1], [7, 8], [2, 6]], Double=[[5.0, 2.0], [3.0, 1.0], [4.0, 5.0]])
    assert get(s.filter("Int", "Double", lambda d: d[0] > 3, dim=0), "Int") == [[3, 1], [2, 6]]


def test_filter_dim1_whole_and_partial(spark):
    s = stream(spark, Int=[[3, 1], [2, 6]], Double=[[5.0, 2.0], [4.0, 5.0]])
    for t in (s, s.rows()):
        whole = t.filter(["Int", "Double"], "Double", lambda d: d >= 5)
        assert get(whole, "Int") == [[3], [6]] and get(whole, "Double") == [[5.0], [5.0]]
        part = t.filter("Double", "Double", lambda d: d >= 5)
        assert get(part, "Int") == [[3, 1], [2, 6]] and get(part, "Double") == [[5.0], [5.0]]


def test_filter_keeps_empty_batches(spark):
    s = Stream.create(spark.createDataFrame([(0, 5), (1, 2), (2, 4), (3, 5)], "k int, v int"), "k")
    s = s.filter(["k", "v"], "v", lambda v: v >= 5)
    assert [len(b) for b in get(s, "v")] == [1, 0, 0, 1]
    assert [len(d["v"]) for d in s.to_python()] == [1, 0, 0, 1]
    assert [r["n"] for r in s.batch_sizes().orderBy(BATCH).collect()] == [1, 0, 0, 1]


def test_filter_dim2(spark):
    s = stream(spark, IntVec1=[[[3, 2], [1, 5]], [[2, 4], [6, 4]]], IntVec2=[[[1, 5], [2, 4]], [[7, 1], [3, 5]]])
    t = s.filter(["IntVec1", "IntVec2"], "IntVec2", lambda v: v >= 4, dim=2)
    assert get(t, "IntVec1") == [[[2], [5]], [[2], [4]]] and get(t, "IntVec2") == [[[5], [4]], [[7], [5]]]


def test_for_each_and_observe(spark):
    s = stream(spark, Int=[[1, 3], [1]], Double=[[5.0, 6.0], [2.0]]).rows()
    seen = Observation()
    assert get(s.observe(seen, F.sum("Int").alias("n")).for_each("Int", lambda pdf: None), "Int") == [[1, 3], [1]]
    assert seen.get["n"] == 5


def test_copy_drop_keep(spark):
    s = stream(spark, Int=[[3], [1]])
    t = s.copy("Int", "Int2").transform("Int", "Int", lambda x: x + 1)
    assert get(t, "Int") == [[4], [2]] and get(t, "Int2") == [[3], [1]]
    assert t.drop("Int").columns == ["Int2"] and t.keep("Int2").columns == ["Int2"]
    for bad in (lambda: t.drop("nothing"), lambda: t.keep("nothing"), lambda: t.copy("nothing", "x"), lambda: t.type_of("nothing")):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError):
        t.copy(["Int"], ["a", "b"])
    assert identity(t) is t and t.size() == 2 and t.contains("Int2") and not t.contains("x")


def test_generate(spark):
    s = stream(spark, IntVec=[[[1, 1, 1], [1, 1]], [[1, 1], [], [1, 1], []]])
    assert get(s.generate("IntVec", "g", lambda p: p, depth=1, fresh=0), "g") == [[[0, 0, 0], [1, 1]], [[2, 2], [], [4, 4], []]]
    assert get(s.running("IntVec", "g"), "g") == [[[0, 1, 2], [3, 4]], [[5, 6], [], [7, 8], []]]
    assert get(s.generate("IntVec", "g", lambda b: b, per_batch=True), "g") == [[0, 0], [1, 1, 1, 1]]


def test_random_fill(spark):
    s = stream(spark, IntVec=[[[1, 1], [1, 1, 1]], [[1, 1], [], [1, 1], []]])
    one = get(s.random_fill("IntVec", "r", depth=1, fresh=0, seed=2), "r")
    assert [[len(set(x)) for x in b] for b in one] == [[1, 1], [1, 0, 1, 0]] and len({v for b in one for x in b for v in x}) == 4
    every = get(s.random_fill("IntVec", "r", depth=1, seed=2), "r")
    assert len({v for b in every for x in b for v in x}) == 9
    for dist, params in (("bernoulli", (0.3,)), ("integer", (2, 4)), ("normal", (10.0, 1.0))):
        values = Stream.create(spark.range(2000), "id", 100).random_fill("id", "r", dist=dist, params=params).unpack("r")
        mean = {"bernoulli": 0.3, "integer": 3, "normal": 10}[dist]
        assert abs(np.mean(np.array(values, float)) - mean) < 0.1


def test_pad(spark):
    s = stream(spark, IntVec=[[[1, 2], [3, 4, 5]], [[], [6, 7]]]).pad("IntVec", "Mask", F.lit(-1))
    assert get(s, "IntVec") == [[[1, 2, -1], [3, 4, 5]], [[-1, -1], [6, 7]]]
    assert get(s, "Mask") == [[[True, True, False], [True] * 3], [[False, False], [True, True]]]
    c = stream(spark, Cube=[[[[1], [2, 3]], [[3, 4]]], [[], [[5, 1]]]]).pad("Cube", "Mask", F.array(F.lit(-1), F.lit(-1)), depth=1)
    assert get(c, "Cube") == [[[[1], [2, 3]], [[3, 4], [-1, -1]]], [[[-1, -1]], [[5, 1]]]]
    both = stream(spark, Cube=[[[[1], [2, 3]], [[4]]]]).pad("Cube", "Mask", F.lit(0), depth=2)
    assert get(both, "Cube") == [[[[1, 0], [2, 3]], [[4, 0], [0, 0]]]]


@pytest.mark.parametrize("n", [3, 1, 100])
def test_rebatch(spark, n):
    sizes, at, batches = [0, 1, 2, 0, 5, 2, 0, 1, 7, 0, 2, 0, 0], 0, []
    for k in sizes:
        batches.append(list(range(at, at + k)))
        at += k
    s = stream(spark, Int=batches).rebatch(n)
    assert get(s, "Int") == [list(range(i, min(20, i + n))) for i in range(0, 20, n)]


def test_rebatch_edges(spark):
    assert get(stream(spark, Int=[[], [], []]).rebatch(1), "Int") == []
    assert get(stream(spark, Int=[[1, 2, 3, 4]] * 3).rebatch(None), "Int") == [[1, 2, 3, 4] * 3]
    with pytest.raises(ValueError):
        stream(spark, Int=[[1]]).rebatch(0)
    s = Stream.create(spark.range(20), "id", 4)
    assert get(s.filter("id", "id", lambda i: i % 3 == 0).rebatch(2), "id") == [[0, 3], [6, 9], [12, 15], [18]]


def test_unpack(spark):
    s = stream(spark, Int=[[3, 1], [7]], IntVec=[[[1, 4], [8, 2]], [[2, 5]]])
    assert s.unpack("Int", 0) == [[3, 1], [7]] and s.unpack("Int") == [3, 1, 7]
    assert s.unpack(["Int", "IntVec"]) == ([3, 1, 7], [[1, 4], [8, 2], [2, 5]])
    assert s.unpack("IntVec", 2) == [1, 4, 8, 2, 2, 5]
    assert stream(spark, Text=[["ab", "c"]]).unpack("Text", 2) == ["a", "b", "c"]


def test_to_python(spark):
    s = stream(spark, Int=[[3, 2], [1, 4]], Double=[[5.0], [2.0]])
    got = list(s.to_python())
    assert [d["Int"].tolist() for d in got] == [[3, 2], [1, 4]] and got[0]["Double"].dtype == np.float64
    nested = next(iter(stream(spark, IntVec=[[[1, 2], []]]).to_python()))["IntVec"]
    assert isinstance(nested, list) and nested[0].dtype == np.int32


def test_take_push_back(spark):
    first, rest = stream(spark, Int=[[0, 1, 2]]).take(2)
    assert get(first, "Int") == [[0, 1]] and get(rest, "Int") == [[2]]
    with pytest.raises(Exception, match="fewer"):
        stream(spark, Int=[[0, 1, 2]]).take(4)[0].df.collect()
    s = stream(spark, Int=[[0, 1, 2]]).push_back(stream(spark, Int=[[3, 4]], Double=[[1.0]]))
    assert get(s, "Int") == [[0, 1, 2, 3, 4]] and get(s, "Double") == [[1.0]]
    with pytest.raises(TypeError):
        s.push_back(stream(spark, Double=[[1.0]]).transform("Double", "Int", lambda d: d.cast("string")))


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_numbering_by_partitions(spark, parts):
    df = spark.range(0, 500, 1, parts).select((F.col("id") * 7919 % 500).alias("k"))
    got = numbered(df, ["k"], small=-1).orderBy("_pos").collect()
    assert [r["k"] for r in got] == list(range(500)) and [r["_pos"] for r in got] == list(range(500))


def test_zip_and_declared_columns(spark):
    a = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "x int, v string")
    b = spark.createDataFrame([(10,), (30,)], "y int")
    assert [tuple(r) for r in zip_frames(a, ["x"], b, [F.col("y").desc()]).orderBy("_pos").collect()] == [(0, 1, "a", 30), (1, 2, "b", 10)]
    with pytest.raises(ValueError):
        zip_frames(a, ["x"], a, ["x"])
    defs = [ColumnDef.of("Int", "int"), ColumnDef.of("Text", "array<string>")]
    assert [d.dimensions() for d in defs] == [1, 3]
    s = host_stream(spark, defs, [{"Int": [1, 2], "Text": [["a"]]}, {"Int": [3]}])
    assert get(s, "Int") == [[1, 2], [3]] and get(s, "Text") == [[["a"]], []]
    with pytest.raises(ValueError):
        host_stream(spark, [defs[0], defs[0]], [])


def test_threads(spark):
    with ThreadPool(3) as pool:
        assert pool.map(lambda n: spark.range(n).count(), [1, 2, 3]) == [1, 2, 3] and pool.enqueue(sum, [1, 2]).result() == 3


def test_sql_view(spark):
    stream(spark, Int=[[1, 2]]).rows().view("numbers")
    assert spark.sql("SELECT sum(Int) AS s FROM numbers").head()["s"] == 3
