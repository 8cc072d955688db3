"""Functions in Python over a stream's elements at any dimension, in Arrow batches; with state, in the stream's order.

A Column expression is the first choice, as it stays inside the JVM. A ``PyFun`` is for what has none: it is called with pandas Series of many elements at
once, whatever the dimension, as nested arrays are flattened by their offsets and put together again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.functions import ndim
from millrace.functions.tuples import as_tuple
from millrace.operators.layout import fixed

@dataclass(frozen=True)
class Scan:
    """A function with state whose stretches can be worked on side by side: what ``PyFun.fun`` is then.

    ``partial`` maps a slice of elements to the state that they leave behind by themselves, ``merge`` two states of neighbouring stretches to that of both (it must be associative), and
    ``results`` the state before a slice (``start`` before the first one) and the slice to its results. Each task reads a range of the stream: a pass gives a state for each range, these are
    merged one after the other, and a second pass gives the results. For a generator a slice is a number of values.
    """

    start: Any
    partial: Callable[..., Any]
    merge: Callable[[Any, Any], Any]
    results: Callable[..., Any]


#: The kind of a target whose elements are characters and are joined to strings.
CHAR = "char"


@dataclass(frozen=True)
class PyFun:
    """``fun`` maps pandas Series, one for each source, to a Series, or a tuple of them, one for each target; ``kinds`` are the types of the targets' elements.

    ``stateful``: ``fun`` has no arguments and gives such a function, which is called with slices of the elements in the stream's order, so that it may keep what it has seen.
    As the order is total, one task reads the stream then, slice by slice; with ``by`` (a column) there is a function for each value of it, which sees
    that value's elements in order, and values are spread over tasks. A task that is run again begins with a new function. A ``Scan`` instead of a function has no such task:
    the stream, and with ``by`` each value's elements too, lie in as many tasks as there are shuffle partitions.
    """

    fun: Callable[..., Any] | Scan
    kinds: str | Sequence[str]
    stateful: bool = False
    by: str | None = None

    def __post_init__(self):
        if isinstance(self.fun, Scan) and not self.stateful:
            raise ValueError("a scan has state: stateful=True")

    def types(self) -> list[str]:
        return [self.kinds] if isinstance(self.kinds, str) else list(self.kinds)


def _flat(array: pa.Array, depth: int, chars: bool) -> tuple[list[pa.Array], pa.Array]:
    """The sizes of ``depth`` levels (null where there is no list) and the elements below them; with ``chars`` the last level are characters."""
    sizes = []
    for level in range(depth):
        if chars and level == depth - 1:
            texts = array.to_pylist()
            sizes.append(pa.array([None if t is None else len(t) for t in texts], pa.int32()))
            array = pa.array([c for t in texts if t is not None for c in t], pa.string())
        else:
            sizes.append(pc.list_value_length(array))
            array = array.flatten()
    return sizes, array


def _nested(sizes: list[pa.Array], values: pa.Array, chars: bool) -> pa.Array:
    """Turns ``_flat`` round."""
    for k, n in enumerate(reversed(sizes)):
        none = n.is_null()
        ends = np.concatenate([[0], np.cumsum(n.fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        if chars and k == 0:
            texts = values.to_pylist()
            values = pa.array([None if x else "".join(texts[a:b]) for a, b, x in zip(ends[:-1], ends[1:], none.to_pylist(), strict=True)], pa.string())
        else:
            values = pa.ListArray.from_arrays(pa.array(ends), values, mask=none if n.null_count else None)
    return values


def _is_chars(kind: T.DataType, depth: int) -> bool:
    return depth > 0 and ndim.ndims(kind) == depth and isinstance(ndim.element_type(kind), T.StringType)


def ordered(df: DataFrame, order: Sequence[str], by: str | None) -> DataFrame:
    """Rows in order in one task, or for each value of ``by`` in one task."""
    if by is None:
        return df.repartition(1).sortWithinPartitions(*order)
    return df.repartition(by).sortWithinPartitions(by, *order)


def scanned(df: DataFrame, order: Sequence[str], by: str | None, scan: Scan, slices: Callable[[pa.RecordBatch], tuple], results: Callable[[Callable[..., Any], pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``df`` in ranges of its order (within values of ``by``), each with the state before it. ``slices`` gives what the scan takes of a batch, ``results`` the batch that a function of it makes."""
    keys = [by] if by else []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fixed(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order))

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[Any, pa.RecordBatch]]:
        """Stretches of one value of ``by``."""
        if not by:
            yield None, batch
            return
        values = batch.column(by).to_pylist()
        edges = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield values[a], batch.slice(a, b - a)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each range: its first and last values of ``by``, whether they are one stretch, and the state of the last one."""
        first, last, one, state, seen = None, None, True, scan.start, False
        for batch in batches:
            if not batch.num_rows:
                continue
            for value, part in runs(batch):
                new = scan.partial(*slices(part))
                if seen and value == last:
                    state = scan.merge(state, new)
                else:
                    first, one = (first, False) if seen else (value, True)
                    last, state, seen = value, new, True
        if seen:
            row = pickle.dumps((first, last, one, state))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([row], pa.binary())], ["part", "row"])

    before: dict[int, Any] = {}
    value, state, any_yet = None, scan.start, False
    for r in sorted(rows.mapInArrow(states, "part int, row binary").collect(), key=lambda r: r["part"]):  # a row for each range
        first, last, one, new = pickle.loads(r["row"])
        goes_on = any_yet and value == first
        if goes_on:
            before[r["part"]] = state
        state = scan.merge(state, new) if goes_on and one else new
        value, any_yet = last, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, seen = before.get(TaskContext.get().partitionId(), scan.start), None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            for value, part in runs(batch):
                if seen and value != last:
                    here = scan.start
                last, seen = value, True
                state = here
                yield results(lambda *x, state=state: scan.results(state, *x), part)
                here = scan.merge(here, scan.partial(*slices(part)))

    return rows.mapInArrow(run, schema)


def apply(df: DataFrame, sources: Sequence[str], targets: Sequence[str], fun: PyFun, depth: int, order: Sequence[str], where: str | None = None) -> DataFrame:
    """``df`` with columns ``targets`` set to ``fun`` of ``sources``, ``depth`` levels down.

    ``where``: a column of booleans of the sources' shape; elements where it doesn't hold keep the targets' values.
    """
    kinds = fun.types()
    if len(kinds) != len(targets):
        raise ValueError(f"{len(kinds)} types for {len(targets)} targets")
    inputs = list(dict.fromkeys([*sources, *([where, *targets] if where else []), *([fun.by] if fun.by else [])]))
    chars = {c: _is_chars(df.schema[c].dataType, depth) for c in inputs}
    out_types = []
    for t, kind in zip(targets, kinds, strict=True):
        if where:  # the target keeps its type
            out_types.append(df.schema[t].dataType)
        elif kind == CHAR:
            out_types.append(ndim.nested(T.StringType(), depth - 1))
        else:
            out_types.append(ndim.nested(T._parse_datatype_string(kind), depth))
    joined = [chars[t] if where else kind == CHAR for t, kind in zip(targets, kinds, strict=True)]
    # the results take the places of the targets in a schema of all columns
    fields = {f.name: f.dataType for f in df.schema}
    fields |= dict(zip(targets, out_types, strict=True))
    schema = T.StructType([T.StructField(n, k) for n, k in fields.items()])
    by, stateful, call = fun.by, fun.stateful, fun.fun
    sources, targets = list(sources), list(targets)

    def elements(kind: T.DataType, is_chars: bool) -> pa.DataType:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.string() if is_chars else to_arrow_type(ndim.element_type(kind, depth))

    def taken(batch: pa.RecordBatch) -> tuple[dict, list, list[pa.Array], pa.Array | None]:
        flat = {c: _flat(batch.column(c), depth, chars[c]) for c in dict.fromkeys([*sources, *([where, *targets] if where else [])])}
        shape = flat[sources[0]][0]
        for c, (sizes, _) in flat.items():
            if not all(a.equals(b.cast(a.type)) for a, b in zip(shape, sizes, strict=True)):
                raise ValueError(f"the columns {sources[0]} and {c} have different sizes")
        values = [flat[c][1] for c in sources]
        mask = None
        if where:
            mask = flat[where][1].cast(pa.bool_()).fill_null(False)
            values = [v.filter(mask) for v in values]
        return flat, shape, values, mask

    def slices(batch: pa.RecordBatch) -> tuple:
        return tuple(v.to_pandas() for v in taken(batch)[2])

    def slice_of(f: Callable[..., Any], batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, shape, values, mask = taken(batch)
        got = as_tuple(f(*(v.to_pandas() for v in values)))
        if len(got) != len(targets):
            raise ValueError(f"the function gives {len(got)} columns for {len(targets)}")
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        for t, kind, is_chars, new in zip(targets, out_types, joined, got, strict=True):
            new = pa.array(new, elements(kind, is_chars), from_pandas=True)
            if len(new) != len(values[0]):
                raise ValueError(f"the function gives {len(new)} elements for {len(values[0])}")
            if where:
                new = pc.replace_with_mask(flat[t][1].cast(new.type), mask, new)
            columns[t] = _nested(shape, new, is_chars)
        return pa.RecordBatch.from_arrays([columns[n] for n in fields], list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if by is None:
            f = call() if stateful else call
            for batch in batches:
                if batch.num_rows:
                    yield slice_of(f, batch)
            return
        f, last = None, None
        for batch in batches:
            keys = batch.column(by).to_pylist()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    if f is None or keys[a] != last:
                        f, last = call(), keys[a]
                    yield slice_of(f, batch.slice(a, b - a))

    if isinstance(call, Scan):
        return scanned(df, order, by, call, slices, slice_of, schema)
    if stateful:
        df = ordered(df, order, by)
    elif by is not None:
        raise ValueError("a function without state needs no column to be parted by")
    return df.mapInArrow(run, schema)


def generated(df: DataFrame, source: str, target: str, fun: PyFun, depth: int, fresh: int, order: Sequence[str]) -> DataFrame:
    """``df`` with a column of the shape of ``source`` down to ``depth`` levels.

    ``fun`` is called with a number of values to give, a value for each element ``fresh`` levels down; deeper elements share it.
    """
    if not 0 <= fresh <= depth:
        raise ValueError("values are fresh at a level of the column")
    (kind,) = (T._parse_datatype_string(k) for k in fun.types())
    fields = {f.name: f.dataType for f in df.schema} | {target: ndim.nested(kind, depth)}
    schema = T.StructType([T.StructField(n, k) for n, k in fields.items()])
    stateful, call, chars = fun.stateful, fun.fun, _is_chars(df.schema[source].dataType, depth)
    if fun.by is not None:
        raise ValueError("a generator runs over the whole stream")

    def needed(batch: pa.RecordBatch) -> tuple[list, int]:
        sizes, _ = _flat(batch.column(source), depth, chars)
        return sizes, batch.num_rows if fresh == 0 else int(pc.sum(sizes[fresh - 1]).as_py() or 0)

    def slice_of(f: Callable[..., Any], batch: pa.RecordBatch) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        sizes, n = needed(batch)
        values = pa.array(f(n), to_arrow_type(kind), from_pandas=True)
        if len(values) != n:
            raise ValueError(f"the generator gives {len(values)} values instead of {n}")
        for level in range(fresh, depth):
            values = values.take(pa.array(np.repeat(np.arange(len(values)), sizes[level].fill_null(0).to_numpy(zero_copy_only=False))))
        columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {target: _nested(sizes, values, False)}
        return pa.RecordBatch.from_arrays([columns[c] for c in fields], list(fields))

    if isinstance(call, Scan):
        return scanned(df, order, None, call, lambda batch: (needed(batch)[1],), slice_of, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = call() if stateful else call
        for batch in batches:
            if batch.num_rows:
                yield slice_of(f, batch)

    return (ordered(df, order, None) if stateful else df).mapInArrow(run, schema)


def keep_column(df: DataFrame) -> str:
    """A name for a column of what a predicate gives."""
    name = "_keep"
    while name in df.columns:
        name = f"_{name}"
    return name
