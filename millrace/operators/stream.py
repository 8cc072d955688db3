"""Streams: ordered batches of named, typed columns, as lazy DataFrame plans.

A stream is in row layout (a row for each example, hidden columns _batch and _pos) as long as the columns of each batch have
equal lengths, and in batch layout (a row for each batch, columns as arrays) when an operator needs whole batches. Dimension 0 is
the batch, 1 the example, 2 and more the levels of nested arrays; the characters of a string are its last dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import ndim
from millrace.functions import random as rnd
from millrace.functions.strings import characters, joined, map_characters
from millrace.functions.tuples import as_tuple
from millrace.operators import pyfun
from millrace.operators.layout import BATCH, POS, assigned, cumulated, equal_sizes, numbered, to_batches, to_rows
from millrace.operators.pyfun import PyFun

Names = str | Sequence[str]


def _names(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


class Stream:
    """An immutable stream; each operator gives a new one."""

    def __init__(self, df: DataFrame, layout: str = "rows", domain: DataFrame | None = None):
        """``domain``: all batch ids where some batches may have no rows left."""
        self.df, self.layout, self.domain = df, layout, domain
        #: Batches that ``to_python`` holds ready: 0 without a bound, None for no buffer.
        self.ahead: int | None = None

    # sources

    @staticmethod
    def create(df: DataFrame, order_by: Sequence[str | Column] | str, batch_size: int = 1, columns: Sequence[str] | None = None) -> Stream:
        """Batches of ``batch_size`` examples in the order of unique keys; the last one may be smaller."""
        if batch_size <= 0:
            raise ValueError("batches must have a positive size")
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        names = list(columns or df.columns)
        if len({n.lower() for n in names}) != len(names):
            raise ValueError("column names must differ")
        rows = numbered(df, order)
        return Stream(rows.select(BATCH_OF(batch_size), POS, *names))

    @staticmethod
    def from_batches(df: DataFrame, batch: str = BATCH) -> Stream:
        """A stream of a DataFrame with a row for each batch and arrays as columns."""
        return Stream(df.withColumnRenamed(batch, BATCH), "batches")

    # metadata

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (BATCH, POS)]

    def size(self) -> int:
        return len(self.columns)

    def contains(self, name: str) -> bool:
        return name in self.columns

    def type_of(self, name: str) -> T.DataType:
        """The type of one example."""
        self._need([name])
        kind = self.df.schema[name].dataType
        return kind.elementType if self.layout == "batches" else kind

    def _need(self, names: Sequence[str]) -> None:
        missing = [n for n in names if n not in self.columns]
        if missing:
            raise KeyError(f"no such column: {', '.join(missing)}")

    def _with(self, df: DataFrame) -> Stream:
        out = Stream(df, self.layout, self.domain)
        out.ahead = self.ahead
        return out

    # layouts

    def batches(self) -> Stream:
        """The same stream in batch layout, batches without examples included."""
        if self.layout == "batches":
            return self
        df = to_batches(self.df, self.columns)
        if self.domain is not None:
            kinds = {f.name: f.dataType for f in df.schema}
            df = self.domain.join(df, BATCH, "left").select(BATCH, *(F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in self.columns))
        return Stream(df, "batches")

    def rows(self) -> Stream:
        """The same stream in row layout; columns of different lengths raise. Batches without examples have no rows."""
        if self.layout == "rows":
            return self
        df = numbered(to_rows(self.df, self.columns), [BATCH, "_i"])
        return Stream(df.select(BATCH, POS, *self.columns), domain=self.df.select(BATCH))

    # operators

    def _order(self) -> list[str]:
        return [POS] if self.layout == "rows" else [BATCH]

    def transform(self, from_: Names, to: Names, fun: Callable[..., Any] | PyFun, dim: int = 1, cond: str | None = None, prob: float | None = None, seed: int | str = 0) -> Stream:
        """Sets columns ``to`` to ``fun`` of columns ``from_`` at a dimension; ``fun`` maps Columns to a Column or a tuple of them, or is a ``PyFun`` of pandas Series.

        ``cond``: only where this column holds. ``prob``: only with this probability, for each element by itself; 0 and 1 are
        decided without a draw. Either way the other elements of ``to`` stay, so these must exist and have one type.
        """
        sources, targets = _names(from_), _names(to)
        self._need([*sources, *([cond] if cond else [])])
        if not targets:
            raise ValueError("no target column")
        if cond is not None or prob is not None:
            self._need(targets)
        if prob is not None and not 0 <= prob <= 1:
            raise ValueError("a probability is from 0 to 1")
        if prob == 0:
            return self
        if prob == 1:
            prob = None
        s = self.batches() if dim == 0 else self
        depth = dim if s.layout == "batches" else dim - 1
        keep = cond is not None or prob is not None
        inputs = [*sources, *([cond] if cond else []), *(t for t in targets if keep)]
        if isinstance(fun, PyFun):
            return s._transform_python(sources, targets, fun, depth, cond, prob, seed)
        n = len(sources)
        strings = [isinstance(ndim.element_type(s.df.schema[c].dataType), T.StringType) and ndim.ndims(s.df.schema[c].dataType) == depth for c in inputs]
        if depth and all(strings) and len(inputs) == len(targets) == 1 and not keep and _gives_text(s.df, inputs[0], fun, depth):
            out = [ndim.lift(lambda x: map_characters(x, fun), [F.col(inputs[0])], depth - 1)]
            return s._with(assigned(s.df, {targets[0]: out[0]}))
        if depth and any(strings):
            return s._transform_characters(sources, targets, fun, dim, cond, prob, seed, depth)
        kinds = {t: ndim.element_type(s.df.schema[t].dataType, depth) for t in targets} if keep else {}

        def one(k: int) -> Callable[..., Column]:
            def at(*x: Column) -> Column:
                value = as_tuple(fun(*x[:n]))
                if len(value) != len(targets):
                    raise ValueError(f"the function gives {len(value)} columns for {len(targets)}")
                if not keep:
                    return value[k]
                old = x[len(inputs) - len(targets) + k]
                test = x[n].cast("boolean") if cond else rnd.uniform(seed, *x[len(inputs) :]) < prob
                return F.when(test, value[k].cast(kinds[targets[k]])).otherwise(old)

            return at

        if prob is None:
            new = {t: ndim.lift(one(k), [F.col(c) for c in inputs], depth) for k, t in enumerate(targets)}
        else:
            new = {t: _lift_with_path(one(k), [F.col(c) for c in inputs], depth, [F.col(POS if s.layout == "rows" else BATCH)]) for k, t in enumerate(targets)}
        return s._with(assigned(s.df, new))

    def _transform_python(self, sources: list[str], targets: list[str], fun: PyFun, depth: int, cond: str | None, prob: float | None, seed: int | str) -> Stream:
        df, where = self.df, None
        if cond is not None or prob is not None:
            where = pyfun.keep_column(df)
            if cond is not None:
                held = F.col(cond) if depth == 0 else ndim.lift(lambda c: c.cast("boolean"), [F.col(cond)], depth)
            elif pyfun._is_chars(df.schema[sources[0]].dataType, depth):
                shape = ndim.lift(characters, [F.col(sources[0])], depth - 1)
                held = _lift_with_path(lambda _, *path: rnd.uniform(seed, *path) < prob, [shape], depth, [F.col(*self._order())])
            else:
                held = _lift_with_path(lambda _, *path: rnd.uniform(seed, *path) < prob, [F.col(sources[0])], depth, [F.col(*self._order())])
            df = df.withColumn(where, held)
        out = pyfun.apply(df, sources, targets, fun, depth, self._order(), where)
        return self._with(out.drop(where) if where else out)

    def _transform_characters(self, sources: list[str], targets: list[str], fun: Callable[..., Any], dim: int, cond: str | None, prob: float | None, seed: int | str, depth: int) -> Stream:
        """``transform`` at the characters of strings: on arrays of them, which are joined again where a target's are characters."""
        df, names = self.df, {}
        for c in dict.fromkeys([*sources, *([cond] if cond else []), *targets]):
            kind = df.schema[c].dataType if c in df.columns else None
            if kind is not None and pyfun._is_chars(kind, depth):
                names[c] = f"_chars_{c}"
                df = df.withColumn(names[c], ndim.lift(characters, [F.col(c)], depth - 1))
        inner = [names.get(c, c) for c in sources]
        to = [names.get(t, f"_chars_{t}") if cond is None and prob is None else names.get(t, t) for t in targets]
        out = self._with(df).transform(inner, to, fun, dim, names.get(cond, cond) if cond else None, prob, seed).df
        for t, name in zip(targets, to, strict=True):
            if name != t:
                text = isinstance(ndim.element_type(out.schema[name].dataType, depth), T.StringType)
                out = out.withColumn(t, ndim.lift(joined, [F.col(name)], depth - 1) if text else F.col(name))
        return self._with(out.drop(*names.values(), *(n for n, t in zip(to, targets, strict=True) if n != t)))

    def filter(self, from_: Names, by: Names, pred: Callable[..., Column] | PyFun, dim: int = 1) -> Stream:
        """Keeps the elements of ``from_`` at a dimension where ``pred`` of ``by`` holds; columns that aren't in ``from_`` stay as they are.

        Dimension 0 keeps whole batches by their arrays. Batches that lose all examples stay, empty. A ``PyFun`` gets pandas Series and gives booleans.
        """
        columns, tests = _names(from_), _names(by)
        self._need([*columns, *tests])
        if isinstance(pred, PyFun):
            name = pyfun.keep_column(self.df)
            told = self.transform(tests, name, pred, dim)
            kept = told.filter([] if dim == 0 else [*columns, name], name, lambda keep: keep, dim)
            return kept.drop(name)
        if dim > 1 or dim == 1 and self.layout == "batches":
            level = dim if self.layout == "batches" else dim - 1
            chars = [c for c in columns if pyfun._is_chars(self.df.schema[c].dataType, level)]
            if chars:  # characters of strings are filtered as arrays
                split = self._with(assigned(self.df, {c: ndim.lift(characters, [F.col(c)], level - 1) for c in chars}))
                out = split.filter(columns, tests, pred, dim)
                return out._with(assigned(out.df, {c: ndim.lift(joined, [F.col(c)], level - 1) for c in chars}))
        if dim == 0:
            s = self.batches()
            return s._with(s.df.where(pred(*(F.col(b) for b in tests))))
        if not set(tests) <= set(columns):
            raise ValueError("a column that the predicate takes must be filtered itself")
        if dim == 1 and self.layout == "rows" and set(columns) == set(self.columns):
            domain = self.domain if self.domain is not None else self.df.select(BATCH).distinct()
            return Stream(self.df.where(pred(*(F.col(b) for b in tests))), "rows", domain)
        s = self.batches() if dim == 1 else self
        depth = dim - 1 if s.layout == "batches" else dim - 2
        new = {}
        for c in columns:
            others = [t for t in tests if t != c]

            def keep(x: Column, *rest: Column, c=c, others=others) -> Column:
                arrays = {c: x, **dict(zip(others, rest, strict=True))}
                ok = ndim.same_size(*arrays.values())
                out = F.filter(x, lambda v, i: pred(*(v if t == c else F.get(arrays[t], i) for t in tests)))
                return out if not rest else F.when(ok, out).otherwise(F.raise_error(F.lit("the columns have different sizes")))

            new[c] = ndim.lift(keep, [F.col(c), *(F.col(o) for o in others)], depth)
        return s._with(assigned(s.df, new))

    def for_each(self, from_: Names, fun: Callable[[Any], None], dim: int = 1) -> Stream:
        """Passes pandas frames of ``from_`` to ``fun`` when the stream is read: rows are examples, or whole batches in dimension 0.

        The values go on unchanged. For sums, ``observe`` needs no Python.
        """
        names = _names(from_)
        self._need(names)
        s = self.batches() if dim == 0 else self.rows()

        def tap(frames):
            for pdf in frames:
                fun(pdf[names])
                yield pdf

        return s._with(s.df.mapInPandas(tap, s.df.schema))

    def observe(self, observation, *aggregates: Column) -> Stream:
        """Aggregates that are collected while the stream is read, beside it."""
        return self._with(self.df.observe(observation, *aggregates))

    def copy(self, from_: Names, to: Names, cast: bool = True) -> Stream:
        """Each source to its target; a target that exists keeps its type."""
        sources, targets = _names(from_), _names(to)
        self._need(sources)
        if len(sources) != len(targets):
            raise ValueError("as many sources as targets are needed")
        kinds = {f.name: f.dataType for f in self.df.schema}
        return self._with(self.df.withColumns({t: F.col(s).cast(kinds[t]) if cast and t in kinds else F.col(s) for s, t in zip(sources, targets, strict=True)}))

    def drop(self, *names: str) -> Stream:
        self._need(names)
        return self._with(self.df.drop(*names))

    def keep(self, *names: str) -> Stream:
        self._need(names)
        return self._with(self.df.select(BATCH, *([POS] if self.layout == "rows" else []), *names))

    def insert_or_assign(self, name: str, value: Column) -> Stream:
        return self._with(self.df.withColumn(name, value))

    def generate(self, from_: str, to: str, make: Callable[..., Column] | PyFun, depth: int = 0, fresh: int | None = None, per_batch: bool = False) -> Stream:
        """A column of the shape of ``from_``: ``depth`` nested levels below the example.

        ``make`` gets the position and the index path of the first ``fresh`` levels (all of them by default); deeper elements share its value.
        ``per_batch``: one value for each batch, from the batch's number. A ``PyFun`` gets how many values to give; with state, it runs on over the stream in order.
        """
        self._need([from_])
        s = self.rows()
        fresh = depth if fresh is None else fresh
        if isinstance(make, PyFun):
            if per_batch:
                raise ValueError("a value for each batch is made by a Column")
            return s._with(pyfun.generated(s.df, from_, to, make, depth, fresh, [POS]))
        if per_batch:
            value = ndim.generate(from_, lambda: make(F.col(BATCH)), depth, 0)
        else:
            value = ndim.generate(from_, lambda *path: make(F.col(POS), *path), depth, fresh)
        return s._with(s.df.withColumn(to, value))

    def running(self, from_: str, to: str, start: Column | int = 0) -> Stream:
        """A column of the shape of the arrays ``from_`` that counts their elements on and on, over all batches in order."""
        self._need([from_])
        s = self.rows()
        df = cumulated(s.df, [POS], F.size(from_).cast("long"), "_before")
        first = F.lit(start) + F.col("_before")
        return s._with(df.withColumn(to, F.transform(from_, lambda x, i: (first + i).cast("long"))).drop("_before"))

    def random_fill(self, from_: str, to: str, depth: int = 0, fresh: int | None = None, dist: str = "uniform", params: tuple = (), seed: int | str = 0, per_batch: bool = False) -> Stream:
        """``generate`` with draws that depend on the seed and the position only."""
        return self.generate(from_, to, lambda *path: rnd.draw(dist, params, seed, *path), depth, fresh, per_batch)

    def pad(self, from_: str, mask: str, value: Column | None = None, depth: int = 1) -> Stream:
        """Fills the arrays of ``depth`` levels up to the largest size in their batch; ``mask`` is true at the original elements."""
        self._need([from_])
        s = self.rows()
        w = Window.partitionBy(BATCH)
        widths = {f"_w{k}": F.max(n).over(w) for k, n in enumerate(ndim.largest(from_, depth))}
        df = s.df.withColumns(widths)
        inner = ndim.element_type(s.df.schema[from_].dataType, depth)
        value = (F.lit(None) if value is None else value).cast(inner)
        cols = [F.col(c) for c in widths]
        return s._with(assigned(df, {from_: ndim.pad_to(from_, cols, value), mask: ndim.mask_to(from_, cols)}).drop(*widths))

    def rebatch(self, n: int | None) -> Stream:
        """Batches of exactly ``n`` examples across the old borders, the last one smaller; None: a single batch. Empty batches vanish."""
        if n is not None and n <= 0:
            raise ValueError("batches must have a positive size")
        s = self.rows()
        if n is None:
            return Stream(s.df.withColumn(BATCH, F.lit(0).cast("long")))
        df = s.df if s.domain is None else numbered(s.df.drop(BATCH), [POS])  # no row has gone since the numbering: positions hold
        return Stream(df.select(BATCH_OF(n), POS, *s.columns))

    def buffer(self, n: int | None = None) -> Stream:
        """The same stream, of which ``to_python`` holds up to ``n`` batches ready while the host works on one (None: as many as come). Executors compute ahead by themselves."""
        if n is not None and n <= 0:
            raise ValueError("a buffer holds one batch at least")
        out = self._with(self.df)
        out.ahead = n or 0
        return out

    def take(self, n: int) -> tuple[Stream, Stream]:
        """The first ``n`` examples of each batch, and the rest; a smaller batch raises."""
        s = self.batches()
        size = equal_sizes(s.columns)
        ok = lambda c: F.when(size >= n, c).otherwise(F.raise_error(F.lit("a batch has fewer examples")))
        first = s.df.select(BATCH, *(ok(F.slice(c, 1, n)).alias(c) for c in s.columns))
        rest = s.df.select(BATCH, *(ok(F.slice(c, n + 1, F.greatest(size - n, F.lit(0)))).alias(c) for c in s.columns))
        return s._with(first), s._with(rest)

    def push_back(self, other: Stream) -> Stream:
        """Appends the batches of equal numbers of another stream; columns that one side lacks are taken from the other."""
        a, b = self.batches(), other.batches()
        both = a.df.join(b.df.select(F.col(BATCH).alias("_b"), *(F.col(c).alias(f"_r_{c}") for c in b.columns)), F.col(BATCH) == F.col("_b"), "full")
        out = [F.coalesce(BATCH, "_b").alias(BATCH)]
        for c in dict.fromkeys([*a.columns, *b.columns]):
            parts = [*([F.col(c)] if c in a.columns else []), *([F.col(f"_r_{c}")] if c in b.columns else [])]
            if len(parts) == 2 and a.df.schema[c].dataType != b.df.schema[c].dataType:
                raise TypeError(f"column {c} has two types")
            kind = (a if c in a.columns else b).df.schema[c].dataType
            out.append(F.concat(*(F.coalesce(p, F.array().cast(kind)) for p in parts)).alias(c))
        return Stream(both.select(*out), "batches")

    def batch_sizes(self) -> DataFrame:
        """_batch, n: each batch's number of examples; columns of different lengths raise."""
        s = self.batches()
        return s.df.select(BATCH, equal_sizes(s.columns).alias("n"))

    def view(self, name: str) -> Stream:
        """Registers the stream as a view for SQL."""
        self.df.createOrReplaceTempView(name)
        return self

    # sinks

    def unpacked(self, from_: Names, dim: int = 1) -> DataFrame:
        """The columns' elements at a dimension as rows, with the places that order them: batch, then position, then an index for each deeper level."""
        names = _names(from_)
        self._need(names)
        if dim == 0:
            return self.batches().df.select(BATCH, *names)
        if self.layout == "batches":
            df, order = to_rows(self.df, names), [BATCH, "_i"]
        else:
            df, order = self.df.select(POS, *names), [POS]
        for level in range(2, dim + 1):
            place = f"_i{level}"
            arrays = [F.split(c, "", -1) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in names]
            zipped = F.arrays_zip(*(a.alias(c) for a, c in zip(arrays, names, strict=True)))
            df = df.select(*order, F.posexplode(zipped).alias(place, "_z")).select(*order, place, *(F.col("_z")[c].alias(c) for c in names))
            order.append(place)
        return df.select(*order, *names)

    def unpack(self, from_: Names, dim: int = 1) -> Any:
        """The columns' elements at a dimension on the host, in order: a list, or a tuple of lists for several columns."""
        names = _names(from_)
        df = self.unpacked(names, dim)
        rows = df.orderBy(*[c for c in df.columns if c not in names]).collect()
        lists = tuple([_plain(r[c]) for r in rows] for c in names)
        return lists[0] if isinstance(from_, str) else lists

    def to_python(self) -> Iterator[dict[str, Any]]:
        """An iterator of dicts, one for each batch in order, of NumPy arrays and lists; the next partition is fetched ahead."""
        from millrace.sources.sinks import batch_dicts

        return batch_dicts(self)


def _gives_text(df: DataFrame, column: str, fun: Callable[..., Any], depth: int) -> bool:
    """Whether a function of a string's characters gives characters."""
    told = ndim.lift(lambda x: F.transform(characters(x), fun), [F.col(column)], depth - 1)
    return isinstance(ndim.element_type(df.select(told.alias("x")).schema["x"].dataType, depth), T.StringType)


def BATCH_OF(n: int) -> Column:  # noqa: N802
    return F.floor(F.col(POS) / n).cast("long").alias(BATCH)


def _plain(value: Any) -> Any:
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _lift_with_path(fun: Callable[..., Column], arrays: Sequence[Column], depth: int, path: list[Column]) -> Column:
    if depth == 0:
        return fun(*arrays, *path)
    first, rest = arrays[0], arrays[1:]
    ok = ndim.same_size(*arrays)
    out = F.transform(first, lambda x, i: _lift_with_path(fun, [x, *(F.get(r, i) for r in rest)], depth - 1, [*path, i]))
    return F.when(ok, out).otherwise(F.raise_error(F.lit("the columns have different sizes")))


def identity(stream: Stream) -> Stream:
    """The stage that does nothing."""
    return stream
