"""Positions and the two layouts of a stream: a row for each example, or a row for each batch with arrays."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POS = "_pos"
BATCH = "_batch"
#: Bytes of a plan's estimated size, and rows as counted, up to which positions and running sums come from one window; larger inputs are numbered by partitions.
SMALL, FEW = 16 << 20, 1 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a new local one in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    sc.setCheckpointDir(root)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{label}-{uuid.uuid4().hex}"


def estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_small(df: DataFrame, small: int = SMALL) -> bool:
    """Whether one task may take all rows: an estimate doesn't see what ``explode`` or a join make of a few rows, so they are counted too, as far as needed."""
    return estimated_bytes(df) <= small and df.select(F.lit(1)).limit(FEW + 1).count() <= FEW


#: Paths in the shared folder that this driver has written and not deleted.
_written: list[str] = []


def fixed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, partition by partition: each later read sees the same rows in the same partitions and order. ``cleanup`` deletes the files."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    _written.append(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def kept_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that ``cleanup`` deletes."""
    _written.append(shared_path(spark, label))
    return _written[-1]


def cleanup(spark: SparkSession) -> None:
    """Deletes what operators have written in this driver: for when their results have been read."""
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = POS, small: int = SMALL) -> DataFrame:
    """Adds 0-based positions in the given order. Keys must be unique, as positions would differ from run to run otherwise: rows of equal keys raise.

    A small input takes one window. A larger one is range-partitioned and sorted, written to the shared checkpoint folder (so that both reads
    below see the same borders; ``cleanup`` deletes it), and each partition adds the number of rows before it.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    if is_small(df, small):
        w = Window.orderBy(*keys)
        place = F.when(F.row_number().over(w) != F.rank().over(w), F.raise_error(F.lit(REPEATED)).cast("int")).otherwise(F.row_number().over(w))
        return df.withColumn(name, (place - 1).cast("long"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fixed(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys))
    # equal keys lie in one partition; only the keys are read for this
    w = Window.partitionBy("_part").orderBy(*keys)
    ranked = rows.withColumn("_part", F.spark_partition_id()).select("_part", (F.row_number().over(w) != F.rank().over(w)).alias("_again"))
    parts = ranked.groupBy("_part").agg(F.count("*").alias("n"), F.max("_again").alias("again")).collect()  # a row for each partition
    if any(r["again"] for r in parts):
        raise ValueError(REPEATED)
    before = _before({r["_part"]: r["n"] for r in parts}, F.spark_partition_id())
    return rows.withColumn(name, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + before)


REPEATED = "the keys of the order repeat"


def _before(sums: dict[int, int], part: Column) -> Column:
    """The sum of the partitions before a row's own, from each partition's."""
    at, starts = 0, []
    for p in range(max(sums, default=-1) + 1):
        starts.append(at)
        at += sums.get(p, 0)
    return F.element_at(F.array(*(F.lit(s).cast("long") for s in starts or [0])), part + 1)


def cumulated(df: DataFrame, order: Sequence[str], value: Column, name: str, small: int = SMALL) -> DataFrame:
    """Adds the sum of ``value`` over all rows before a row in the order of unique keys; by partitions as ``numbered``, if the input isn't small."""
    earlier = (Window.unboundedPreceding, -1)
    if is_small(df, small):
        return df.withColumn(name, F.coalesce(F.sum(value).over(Window.orderBy(*order).rowsBetween(*earlier)), F.lit(0).cast("long")))
    n, columns = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.columns
    rows = fixed(df.withColumn("_value", value.cast("long")).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: r["s"] for r in rows.groupBy("_part").agg(F.coalesce(F.sum("_value"), F.lit(0)).alias("s")).collect()}  # a row for each partition
    before = _before(sums, F.col("_part"))
    inside = F.coalesce(F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    return rows.withColumn(name, inside + before).select(*columns, name)


def assigned(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with columns set at once, all from its own columns.

    ``withColumns`` doesn't do: a name inside a lambda function is taken for a column of the same list that is set before it, if there is one.
    """
    made = df.select("*", *(value.alias(f"_new_{i}") for i, value in enumerate(new.values())))
    at = {name: f"_new_{i}" for i, name in enumerate(new)}
    return made.select(*(F.col(at[c]).alias(c) if c in at else F.col(c) for c in dict.fromkeys([*df.columns, *new])))


def to_batches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each batch: every column an array in the order of positions."""
    listed = F.collect_list(F.struct(POS, *columns))
    ordered = F.array_sort(listed) if _orderable(df, columns) else F.array_sort(listed, _by_position)
    rows = df.groupBy(BATCH).agg(ordered.alias("_rows"))
    return rows.select(BATCH, *(_field(c) for c in columns))


def _orderable(df: DataFrame, columns: Sequence[str]) -> bool:
    return not any("map<" in df.schema[c].dataType.simpleString() for c in columns)


def _by_position(x: Column, y: Column) -> Column:
    return F.when(x[POS] < y[POS], -1).when(x[POS] > y[POS], 1).otherwise(0)


def _field(name: str) -> Column:
    return F.transform("_rows", lambda r: r[name]).alias(name)


def equal_sizes(columns: Sequence[str]) -> Column:
    """The common size of a batch's arrays; a batch whose columns have different lengths raises. No column: 0."""
    if not columns:
        return F.lit(0)
    n = F.size(columns[0])
    ok = F.lit(True)
    for c in columns[1:]:
        ok = ok & (F.size(c) == n)
    return F.when(ok, n).otherwise(F.raise_error(F.lit("the columns of a batch have different lengths")).cast("int"))


def to_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each example of each batch, with _i its place in the batch."""
    n = equal_sizes(columns)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = df.select(BATCH, *columns, F.explode(places).alias("_i"))
    return rows.select(BATCH, F.col("_i"), *(F.get(c, F.col("_i")).alias(c) for c in columns))


def zip_frames(left: DataFrame, left_order: Sequence[str | Column], right: DataFrame, right_order: Sequence[str | Column]) -> DataFrame:
    """The rows of two DataFrames side by side by position, with _pos; the shorter one ends it. Columns must have different names."""
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if both:
        raise ValueError(f"both sides have columns {sorted(both)}")
    return numbered(left, left_order).join(numbered(right, right_order), POS)
