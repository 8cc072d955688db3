import pytest
from pyspark.sql import functions as F

from millrace.operators.layout import BATCH
from millrace.operators.stream import Stream
from millrace.streaming.adapter import flush, micro_batches, stateless


def write(spark, path, values):
    spark.createDataFrame([(v,) for v in values], "k long").coalesce(1).write.mode("append").parquet(path)


def test_stateless(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, range(10))
    source = spark.readStream.schema("k long").parquet(path)
    out = stateless(source, lambda s: s.transform("k", "k", lambda k: k * 2).filter("k", "k", lambda k: k > 10).copy("k", "c"))
    q = out.writeStream.format("memory").queryName("doubled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["c"] for r in spark.sql("SELECT * FROM doubled").collect()) == [12, 14, 16, 18]
    with pytest.raises(ValueError):
        stateless(spark.range(3), lambda s: s)
    with pytest.raises(ValueError):
        stateless(source, lambda s: s.transform("k", "k", F.reverse, dim=0))


def test_micro_batches_carry_their_rest(spark, tmp_path):
    path, rest, mark = (str(tmp_path / x) for x in ("in", "rest", "mark"))
    got: dict[int, list[int]] = {}

    def sink(s: Stream, epoch: int) -> None:
        for r in s.batches().df.collect():
            got[r[BATCH]] = r["k"]

    for lo, hi in ((0, 7), (7, 9), (9, 20)):
        write(spark, path, range(lo, hi))
        source = spark.readStream.schema("k long").parquet(path)
        micro_batches(source, "k", 4, sink, rest, mark).awaitTermination()
    last = flush(spark, rest, 2, spark.createDataFrame([], "k long"), "k", 4)
    assert got == {i: list(range(4 * i, 4 * i + 4)) for i in range(5)} and last.unpack("k") == []
