"""What the operators of this subpackage share: written tables, Arrow loops, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once.
CHUNK_BYTES = 2 << 20


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a new local one in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    root = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    sc.setCheckpointDir(root)
    return sc._jsc.sc().getCheckpointDir().get()


#: Paths of the tables that this driver has written and not deleted, in order.
_tables: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _tables:
        _tables.remove(path)


def forget(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    _delete(df.sparkSession, df._millrace_path)


def cleanup(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> None:
    """Deletes every table that operators have written in this driver (after the first ``since`` of them) but ``keep``: for when their results have been read."""
    for path in _tables[since:]:
        if keep is None or path != keep._millrace_path:
            _delete(spark, path)


def table_count() -> int:
    """How many written tables there are now: what ``cleanup`` takes as ``since``."""
    return len(_tables)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns doc_id and text alone (null text: empty), whatever else ``df`` has."""
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` has about ``most`` bytes at the most, one row at least."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        n = int(np.searchsorted(np.cumsum(lengths[at:]), most, "right"))
        yield batch.slice(at, max(1, n))
        at += max(1, n)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its offsets (rows + 1), starting at 0. Null: empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case, of any script."""
    return buffer_of(pc.utf8_lower(column))


#: What empties the memos of this worker process.
_memos: list[Callable[[], None]] = []


def release() -> None:
    """Empties the memos that another operator's tasks have left in this worker, which Spark uses again, and gives free memory back to the system."""
    for clear in _memos:
        clear()
    trim_memory()


def trim_memory() -> None:
    """Gives the free memory of this worker back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes that a worker keeps when it frees them, and of an array up to which this goes.
KEPT, KEPT_ARRAY = 64 << 20, 32 << 20


def keep_freed() -> None:
    """Lets this worker use freed memory again for the arrays of its next step; each step would otherwise give it back to the system and take it page by page."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option:
        option(-3, KEPT_ARRAY)  # M_MMAP_THRESHOLD
        option(-1, KEPT)  # M_TRIM_THRESHOLD


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str, most: int = CHUNK_BYTES, memos: bool = False) -> DataFrame:
    """``mapInArrow`` in slices of bounded bytes; ``make`` is called once a task and gives the slice function. ``memos``: those of earlier tasks are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if memos:
            trim_memory()
        else:
            release()
        f = make()
        for batch in batches:
            for part in chunks(batch, column, most):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


#: Entries in a slice of a count table; groups of tasks whose slices are summed together before the last sum.
SLICE = 1024
FAN = 8


#: Bytes of input, by the plan's estimate, for which a task is worth a table of its own.
TABLE_BYTES = 64 << 20


def in_few_tasks(df: DataFrame) -> DataFrame:
    """``df`` in no more tasks than its size or the cluster's cores ask for: each of them sends a table, whatever it reads. Partitions are put together where they are, without a shuffle."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(min(1 << 30, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // TABLE_BYTES))))


def table_rows(counts: np.ndarray, dtype: str) -> pa.RecordBatch:
    """A table as rows (slice, counts) without its empty slices."""
    slices = counts.reshape(-1, SLICE)
    at = np.flatnonzero(slices.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([x.tobytes() for x in slices[at].astype(dtype)], pa.binary())], ["slice", "counts"])


def table_sum(rows: DataFrame, dtype: str, total: str = "<i8", either: bool = False, unit: float = 0) -> DataFrame:
    """The sum (or the bitwise or) of tables in rows (slice, counts), as one row for each slice; with ``unit``, in whole numbers of it.

    It goes in two levels, so that no task reads a slice from every task before: ``FAN`` groups of tasks first, then the groups.
    """

    def add(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: dict[int, np.ndarray] = {}
            for b in batches:
                for k, x in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                    x = np.frombuffer(x, kind)
                    x = (np.rint(x / unit) if unit and kind == dtype else x).astype(total)
                    got[k] = x if k not in got else got[k] | x if either else got[k] + x
            keys = [*got]
            for a in range(0, len(keys), 64):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 64], pa.int32()), pa.array([got[k].tobytes() for k in keys[a : a + 64]], pa.binary())], ["slice", "counts"])

        return run

    schema = "slice int, counts binary"
    some = rows.select("slice", "counts", F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("part")).repartition("slice", "part").select("slice", "counts").mapInArrow(add(dtype), schema)
    return some.repartition("slice").mapInArrow(add(total), schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: For each byte: 1 in words, 0 between them, which is white space; or where punctuation counts as well, all of ASCII but letters and digits.
WHITE_SPACE = bytes(b not in (9, 10, 11, 12, 13, 32) for b in range(256))
PUNCTUATION = bytes(b >= 128 or chr(b).isalnum() for b in range(256))
LONG_WORD = 64
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        p = 0xD6E8FEB86659FD93
        for name, base in (("up", p), ("down", pow(p, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(raw: np.ndarray):
    """A function of (starts, ends) that gives the hashes of spans of bytes, A-Z lowered; the same for a word and for another's beginning that is equal to it."""
    n = len(raw)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    values = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8).astype(np.uint64)
    values *= up[:n]
    np.cumsum(values, out=sums[1:])
    return lambda starts, ends: mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, space: bytes = WHITE_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` (or what ``space`` leaves) of concatenated texts, A-Z lowered.

    Gives each word's 64-bit hash, first byte, byte after the last, and for each text the index of its first word (texts + 1).
    A word's hash is a polynomial over its bytes, taken from prefix sums, then mixed with its length; for words of more than ``LONG_WORD`` bytes, where a
    polynomial modulo 2**64 has collisions that can be written down, a digest.
    """
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    inside = np.frombuffer(raw.tobytes().translate(space), bool)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    before[cut] = False  # a text begins
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = span_hashes(raw)(starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        word = raw[starts[i] : ends[i]].tobytes().translate(_LOWER)
        hashes[i] = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64)[0]
    return hashes, starts, ends, np.searchsorted(starts, offsets)


_SLOT = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's ``width``-word shingles and each text's bounds in them (texts + 1).

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(first)
    n_shingles = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(n_shingles)])
    total = int(bounds[-1])
    if not total:
        return np.zeros(0, np.uint64), bounds
    at = np.arange(total) - np.repeat(bounds[:-1], n_shingles) + np.repeat(first[:-1], n_shingles)
    have = np.repeat(np.minimum(counts, width), n_shingles)
    out = np.zeros(total, np.uint64)
    for k in range(width):
        use = have > k
        out[use] += words[at[use] + k] * _SLOT[k]
    return mixed(out + have.astype(np.uint64)), bounds
