"""Endless sources: stateless operators run on the streaming plan, batches are cut from each micro-batch with a carried rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.layout import BATCH, POS, numbered
from millrace.operators.stream import Stream


def stateless(source: DataFrame, plan: Callable[[Stream], Stream]) -> DataFrame:
    """A streaming plan of operators that need neither positions nor batches (transform, filter, copy, drop, keep from dimension 1 on)."""
    if not source.isStreaming:
        raise ValueError("not a streaming source")
    out = plan(Stream(source.withColumns({BATCH: F.lit(0).cast("long"), POS: F.lit(0).cast("long")})))
    if out.layout != "rows":
        raise ValueError("an endless stream has no batch layout; use micro_batches")
    return out.df.select(*out.columns)


def micro_batches(source: DataFrame, order_by: str, batch_size: int, sink: Callable[[Stream, int], None], rest_table: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that hands ``sink`` streams of whole batches of ``batch_size`` examples, numbered on and on. Values of ``order_by`` must differ.

    What a micro-batch leaves over is kept in the table ``rest_table`` and goes before the next one; ``flush`` gives out the last of it. The table is
    written for each epoch anew, so an epoch that is run again after a failure starts from the same rest; those of epochs that can't be run again are removed.
    ``trigger``: when micro-batches begin, as Structured Streaming takes it, such as ``{"processingTime": "10 seconds"}`` for an endless query; without it the
    query takes what is there and stops.
    """

    def handle(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        columns = df.columns
        rest, done = _rest(spark, rest_table, epoch - 1, df)
        df = df.persist()
        rows = numbered(rest.withColumn("_new", F.lit(0)).unionByName(df.withColumn("_new", F.lit(1))), ["_new", order_by]).drop("_new")
        whole = rows.count() // batch_size * batch_size
        left = rows.where(F.col(POS) >= whole).select(*columns)
        left.withColumns({"_epoch": F.lit(epoch).cast("long"), "_done": F.lit(done + whole // batch_size).cast("long")}).write.mode("overwrite").parquet(f"{rest_table}/epoch={epoch}")
        spark.createDataFrame([(done + whole // batch_size,)], "done long").write.mode("overwrite").parquet(f"{rest_table}-done/epoch={epoch}")
        if whole:
            ready = rows.where(F.col(POS) < whole)
            sink(Stream(ready.select((F.floor(F.col(POS) / batch_size) + done).cast("long").alias(BATCH), (F.col(POS) + done * batch_size).alias(POS), *columns)), epoch)
        df.unpersist()
        for table in (rest_table, f"{rest_table}-done"):
            _remove(spark, f"{table}/epoch={epoch - 2}")

    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _rest(spark: SparkSession, table: str, epoch: int, like: DataFrame) -> tuple[DataFrame, int]:
    if epoch < 0:
        return spark.createDataFrame([], like.schema), 0
    rows = spark.read.schema(like.schema).parquet(f"{table}/epoch={epoch}")
    return rows.select(*like.columns), spark.read.schema("done long").parquet(f"{table}-done/epoch={epoch}").head()["done"]


def flush(spark: SparkSession, rest_table: str, epoch: int, like: DataFrame, order_by: str, batch_size: int) -> Stream:
    """The last, smaller batch that was left after an epoch."""
    rest, done = _rest(spark, rest_table, epoch, like)
    rows = numbered(rest, [order_by])
    return Stream(rows.select(F.lit(done).cast("long").alias(BATCH), (F.col(POS) + done * batch_size).alias(POS), *like.columns))
