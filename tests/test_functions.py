import base64

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import ndim, strings, tuples
from millrace.functions.random import bernoulli, integer, uniform


def value(spark, c, row=None, kind="int"):
    df = spark.createDataFrame([(row,)], f"a {kind}") if row is not None else spark.range(1)
    return df.select(c.alias("x")).head()["x"]


A2, A3 = "array<array<int>>", "array<array<array<int>>>"


def test_types():
    kind = T.ArrayType(T.ArrayType(T.StringType()))
    assert ndim.ndims(kind) == 3 and ndim.element_type(kind) == T.StringType() and ndim.element_type(kind, 1) == T.ArrayType(T.StringType())
    assert ndim.nested(T.IntegerType(), 2) == T.ArrayType(T.ArrayType(T.IntegerType()))
    with pytest.raises(ValueError):
        ndim.element_type(T.ArrayType(T.IntegerType()), 2)


def test_sizes_and_shape(spark):
    assert value(spark, ndim.sizes("a", 2), [[1, 2, 3], [], [1, 2]], A2) == [[3], [3, 0, 2]]
    assert value(spark, ndim.sizes("a", 3), [[], []], A3) == [[2], [0, 0], []]
    cube = [[[0] * 4] * 3] * 2
    assert value(spark, ndim.shape("a", 2), cube, A3) == [2, 3] and value(spark, ndim.shape("a", 3), [[], []], A3) == [2, 0, 0]
    assert value(spark, ndim.flat("a", 3), [[[1], [2, 3]], [], [[4]]], A3) == [1, 2, 3, 4]


def test_pad_and_resize(spark):
    assert value(spark, ndim.pad("a", 2, F.lit(-1)), [[1, 2], [3, 4, 5], [], [6]], A2) == [[1, 2, -1], [3, 4, 5], [-1] * 3, [6, -1, -1]]
    assert value(spark, ndim.pad("a", 3, F.lit(0)), [[[1], [2, 3]], [[4]]], A3) == [[[1, 0], [2, 3]], [[4, 0], [0, 0]]]
    size = F.array(F.array(F.lit(5)))
    assert value(spark, ndim.resize("a", size, 1, F.lit(1)), [7, 8, 9], "array<int>") == [7, 8, 9, 1, 1]
    size = F.array(F.array(F.lit(3)), F.array(F.lit(2), F.lit(3), F.lit(1)))
    assert value(spark, ndim.resize("a", size, 2, F.lit(2)), [[1, 1, 1], [3, 4]], A2) == [[1, 1], [3, 4, 2], [2]]


@pytest.mark.parametrize("shape, expected", [((3, 5), 3), ((3, -1), 3), ((-1, 5), 3), ((3, 1, 5), 3), ((-1,), 15), ((3, -1, 5), 3)])
def test_reshape(spark, shape, expected):
    got = value(spark, ndim.reshape("a", shape), list(range(15)), "array<int>")
    flat = got
    for _ in shape[1:]:
        flat = [y for x in flat for y in x]
    assert len(got) == expected and flat == list(range(15))


def test_reshape_rejects(spark):
    with pytest.raises(Exception, match="fit"):
        value(spark, ndim.reshape("a", (4, 4)), list(range(15)), "array<int>")
    with pytest.raises(ValueError):
        ndim.reshape("a", (-1, -1))


def test_generate_and_same_size(spark):
    shape = [[[0, 0, 0], [0]], [[], []], [[0], [0, 0]]]
    assert value(spark, ndim.generate("a", lambda: F.lit(7), 3, 0), shape, A3) == [[[7, 7, 7], [7]], [[], []], [[7], [7, 7]]]
    assert value(spark, ndim.generate("a", lambda i, j: i * 10 + j, 3, 2), shape, A3) == [[[0, 0, 0], [1]], [[], []], [[20], [21, 21]]]
    one, two = F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))
    assert value(spark, ndim.same_size()) and value(spark, ndim.same_size(one, one)) and not value(spark, ndim.same_size(one, two))


def test_base64(spark):
    data = bytes([0, 120, 15, 10, 0, 0, 0, 0])
    for n in range(9):
        x = bytearray(data[:n])
        text = value(spark, strings.base64_encode("a"), x, "binary")
        assert text == base64.b64encode(data[:n]).decode()
        assert bytes(value(spark, strings.base64_decode("a"), text, "string")) == data[:n] == bytes(value(spark, strings.base64_decode("a"), text.rstrip("="), "string"))
    assert "\n" not in value(spark, strings.base64_encode("a"), bytearray(500), "binary")


def test_string_conversion(spark):
    for word in strings.TRUE:
        assert value(spark, strings.string_to("a", "boolean"), word, "string") is True and value(spark, strings.string_to_bool("a"), word + " ", "string") is True
    for word in strings.FALSE:
        assert value(spark, strings.string_to("a", "boolean"), word, "string") is False
    for word in ("trUe", "fAlse", "abc", "2", ""):
        with pytest.raises(Exception, match="boolean"):
            value(spark, strings.string_to_bool("a"), word, "string")
    assert value(spark, strings.string_to("a", "int"), "12", "string") == 12
    for bad in (" 1 ", "x", ""):
        with pytest.raises(Exception):
            value(spark, strings.string_to("a", "int"), bad, "string")
    assert value(spark, strings.to_string(F.lit(True))) == "true"
    assert value(spark, strings.map_characters("a", lambda c: F.chr(F.ascii(c) + 1)), "abc", "string") == "bcd"
    assert value(spark, strings.map_characters("a", lambda c: c), "", "string") == ""


def test_random(spark):
    df = spark.range(1000).select(uniform(1, F.col("id")).alias("u"), bernoulli(0.2, 1, F.col("id")).alias("b"), integer(1, 6, 1, F.col("id")).alias("i"), bernoulli(1, 1, F.col("id")).alias("one")).toPandas()
    assert 0 <= df.u.min() and df.u.max() < 1 and abs(df.u.mean() - 0.5) < 0.05 and abs(df.b.mean() - 0.2) < 0.05 and set(df.i) == {1, 2, 3, 4, 5, 6} and df.one.all()


def test_tuples(spark):
    assert tuples.find(2, [1, 2]) == 1 and tuples.find(5, [1]) == 1 and tuples.contains(1, [1]) and not tuples.contains(2, [1])
    assert tuples.maybe_tuple(1) == 1 and tuples.maybe_tuple(1, 2) == (1, 2) and tuples.maybe_untuple((1,)) == 1 and tuples.as_tuple([1]) == (1,)
    assert tuples.unzip([(1, "a"), (2, "b")]) == ([1, 2], ["a", "b"]) and tuples.unzip_if(False, [1, 2]) == [1, 2] and tuples.text((1, "a")) == "(1, a)"
    seen = []
    tuples.for_each((1, 2), seen.append)
    tuples.for_each_with_index("ab", lambda v, i: seen.append((v, i)))
    tuples.times_with_index(2, seen.append)
    assert seen == [1, 2, ("a", 0), ("b", 1), 0, 1] and tuples.offsets(3, 2) == (3, 4)
    assert tuples.transformed((1, 2), str) == ("1", "2") and tuples.transformed_with_index((5, 6), lambda v, i: v * i) == (0, 6)
    df = spark.createDataFrame([(1, 2, ("b", 2)), (1, 1, ("a", 1))], "k int, o int, s struct<x:string,y:int>")
    assert tuple(tuples.unzip_groups(df, "s", "k", "o").head()) == (1, ["a", "b"], [1, 2])
