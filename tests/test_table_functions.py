import pytest

from millrace.functions import tables


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)
    rows = [("a", i, [f"w{j}" for j in range(i % 3)]) for i in range(5)] + [("b", 9, None), (None, 1, ["x", None])]
    spark.createDataFrame(rows, "k string, i int, words array<string>").repartition(3).createOrReplaceTempView("udtf_rows")
    spark.sql("SELECT * FROM udtf_rows WHERE false").createOrReplaceTempView("udtf_none")
    return lambda q: [tuple(r) for r in spark.sql(q).collect()]


def test_create(sql):
    got = sql("SELECT k, i, batch, place FROM create_batches(TABLE(udtf_rows) PARTITION BY k ORDER BY (i DESC), 2)")
    assert sorted(got, key=repr) == sorted([("a", 4 - n, n // 2, n % 2) for n in range(5)] + [("b", 9, 0, 0), (None, 1, 0, 0)], key=repr)
    assert sql("SELECT * FROM create_batches(TABLE(udtf_none) PARTITION BY k ORDER BY (i), 2)") == []


def test_pad_and_unpack(sql):
    got = sql("SELECT k, i, words, mask FROM pad_batches(TABLE(udtf_rows) PARTITION BY k ORDER BY (i), 'words')")
    assert ("a", 0, [None, None], [False, False]) in got and ("a", 4, ["w0", None], [True, False]) in got and ("b", 9, [], []) in got and (None, 1, ["x", None], [True, True]) in got and len(got) == 7
    got = sql("SELECT k, n, i, element FROM unpack_elements(TABLE(SELECT k, i AS n, words FROM udtf_rows), 'words')")
    assert sorted(got, key=repr) == sorted([("a", n, j, f"w{j}") for n in range(5) for j in range(n % 3)] + [(None, 1, 0, "x"), (None, 1, 1, None)], key=repr)


@pytest.mark.parametrize("call", ["create_batches(TABLE(udtf_rows), 0)", "pad_batches(TABLE(udtf_rows), 'k')", "unpack_elements(TABLE(udtf_rows), 'words')", "pad_batches(TABLE(udtf_rows), 'none')", "create_batches(TABLE(SELECT 1 AS batch), 2)"])
def test_wrong_calls(sql, call):
    with pytest.raises(Exception, match="positive size|no column of arrays|already"):
        sql(f"SELECT * FROM {call}")
