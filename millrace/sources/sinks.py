"""From batches to the host: NumPy conversion, iteration, sequence views, host batches, folders."""

from __future__ import annotations

import os
import queue
import secrets
import threading
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
from pyspark.sql import types as T

from millrace.operators.layout import BATCH

#: NumPy types of columns.
DTYPES = {T.BooleanType: np.bool_, T.ByteType: np.int8, T.ShortType: np.int16, T.IntegerType: np.int32, T.LongType: np.int64, T.FloatType: np.float32, T.DoubleType: np.float64}


def to_ndarray(values: Sequence[Any], kind: T.DataType) -> np.ndarray:
    """A typed array of numbers or booleans, an object array of anything else."""
    dtype = DTYPES.get(type(kind))
    if dtype is not None and all(v is not None for v in values):
        return np.asarray(values, dtype)
    out = np.empty(len(values), object)
    out[:] = values
    return out


def to_python(values: Any, kind: T.DataType) -> Any:
    """Nested lists with the innermost level as arrays."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.ArrayType):
            return [to_python(v, kind.elementType) for v in values]
        return to_ndarray(values, kind.elementType)
    return values


def batch_dicts(stream) -> Iterator[dict[str, Any]]:
    """A dict for each batch in order; with a buffer, made ready by a thread of its own."""
    s = stream.batches()
    kinds = {c: s.df.schema[c].dataType for c in s.columns}

    def made() -> Iterator[dict[str, Any]]:
        for row in s.df.orderBy(BATCH).toLocalIterator(prefetchPartitions=True):
            yield {c: to_python(row[c], kinds[c]) for c in kinds}

    return made() if stream.ahead is None else buffered(made(), stream.ahead)


def buffered(values: Iterator, n: int) -> Iterator:
    """The values in order, up to ``n`` of them (0: any number) taken ahead by a thread. It ends when the values do, or when nobody reads any more."""
    held: queue.Queue = queue.Queue(n)
    stop = threading.Event()

    def put(item) -> bool:
        while not stop.is_set():
            try:
                held.put(item, timeout=0.1)
                return True
            except queue.Full:
                continue
        return False

    def fill() -> None:
        try:
            for v in values:
                if not put((v, None)):
                    return
            put((None, StopIteration()))
        except BaseException as e:  # noqa: BLE001 - it is raised where the values are read
            put((None, e))

    threading.Thread(target=fill, daemon=True).start()
    try:
        while True:
            value, end = held.get()
            if isinstance(end, StopIteration):
                return
            if end is not None:
                raise end
            yield value
    finally:
        stop.set()


class Batch:
    """A batch on the host: named columns of any lengths."""

    def __init__(self, columns: dict[str, list] | None = None):
        self._columns = {k: list(v) for k, v in (columns or {}).items()}

    def at(self, name: str) -> list:
        return self._columns[name]

    extract = at

    def insert_or_assign(self, name: str, values: Sequence) -> None:
        self._columns[name] = list(values)

    def size(self) -> int:
        return len(self._columns)

    def contains(self, name: str) -> bool:
        return name in self._columns

    def erase(self, name: str) -> None:
        del self._columns[name]

    def batch_size(self) -> int:
        """The columns' common length, 0 without columns; different lengths raise."""
        sizes = {len(v) for v in self._columns.values()}
        if len(sizes) > 1:
            raise RuntimeError("the columns have different lengths")
        return sizes.pop() if sizes else 0

    def take(self, n: int) -> Batch:
        """Splits the first ``n`` examples off."""
        if n > self.batch_size():
            raise RuntimeError("the batch has fewer examples")
        out = Batch({k: v[:n] for k, v in self._columns.items()})
        self._columns = {k: v[n:] for k, v in self._columns.items()}
        return out

    def push_back(self, other: Batch) -> None:
        for k, v in other._columns.items():
            self._columns.setdefault(k, []).extend(v)

    def to_python(self) -> dict[str, list]:
        return dict(self._columns)


class Range(Sequence):
    """A sequence view of an iterable: read once when it is first indexed; slices have no step."""

    def __init__(self, values):
        self._source, self._values = values, list(values) if isinstance(values, (list, tuple, range)) else None

    def _all(self) -> list:
        if self._values is None:
            self._values = list(self._source)
        return self._values

    def __iter__(self):
        yield from self._source if self._values is None else self._values

    def __len__(self) -> int:
        return len(self._all())

    def __getitem__(self, i):
        if isinstance(i, slice):
            if i.step not in (None, 1):
                raise ValueError("a slice has no step")
            return Range(self._all()[i])
        return self._all()[i]


def create_temp_directory(pattern: str) -> str:
    """A new folder on this machine, each % of the pattern a random hexadecimal digit."""
    for _ in range(100):
        path = "".join(secrets.choice("0123456789abcdef") if c == "%" else c for c in pattern)
        try:
            os.makedirs(path)
            return path
        except FileExistsError:
            continue
    raise RuntimeError("no free name was found")


def encode_image(array: np.ndarray) -> dict:
    """A numeric array as a struct value (shape, dtype, data)."""
    return {"shape": list(array.shape), "dtype": array.dtype.str, "data": np.ascontiguousarray(array).tobytes()}


def decode_image(value) -> np.ndarray:
    return np.frombuffer(bytes(value["data"]), np.dtype(value["dtype"])).reshape(value["shape"])


#: Column types of images and points.
IMAGE = "struct<shape:array<int>,dtype:string,data:binary>"
POINT = "struct<x:float,y:float>"


def point(value) -> tuple[float, float]:
    return (value["x"], value["y"])
