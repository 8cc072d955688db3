"""Endless sources with state for each key, kept in Spark's own state store: batches by key, sessions with late rows apart, windows of event time.

State lies in RocksDB and goes with the query's checkpoint, so a query that is started again goes on where it was. Spark's state store must be told before the query starts: ``use_rocksdb``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Queries that are started from now on keep their state in RocksDB, which state of several kinds needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Batches(StatefulProcessor):
    def __init__(self, key: str, columns: Sequence[str], order_by: str, size: int, idle_ms: int | None, rest: T.StructType):
        self.key, self.columns, self.order_by, self.size, self.idle_ms, self.rest_type = key, list(columns), order_by, size, idle_ms, rest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = handle.getListState("rest", self.rest_type)
        self.done = handle.getValueState("done", "batches long, timer long")

    def _state(self) -> tuple[int, int]:
        return self.done.get() if self.done.exists() else (0, -1)

    def _given(self, key: tuple, rows: pd.DataFrame, first: int) -> pd.DataFrame:
        out = rows[self.columns].copy()
        out.insert(0, "place", range(len(out)))
        out["place"] %= self.size
        out.insert(0, "batch", [first + i // self.size for i in range(len(out))])
        out.insert(0, self.key, key[0])
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batches, timer = self._state()
        new = pd.concat(list(rows))[self.columns].sort_values(self.order_by, kind="stable")
        old = pd.DataFrame(list(self.rest.get()), columns=self.columns) if self.rest.exists() else new.iloc[:0]
        every = pd.concat([old.astype(new.dtypes.to_dict()), new], ignore_index=True) if len(old) else new.reset_index(drop=True)
        whole = len(every) // self.size * self.size
        left = every.iloc[whole:]
        if whole:
            yield self._given(key, every.iloc[:whole], batches)
        self.rest.clear()
        if len(left):
            self.rest.put([tuple(r) for r in left.astype(object).where(left.notna(), None).itertuples(index=False, name=None)])
        if self.idle_ms is not None:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms if len(left) else -1
            if timer >= 0:
                self.handle.registerTimer(timer)
        self.done.update((batches + whole // self.size, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batches, timer = self._state()
        if timer == expiredTimerInfo.getExpiryTimeInMs() and self.rest.exists():
            yield self._given(key, pd.DataFrame(list(self.rest.get()), columns=self.columns), batches)
            self.rest.clear()
            self.done.update((batches + 1, -1))

    def close(self) -> None:
        pass


def rebatch_by_key(source: DataFrame, key: str, order_by: str, batch_size: int, idle_ms: int | None = None) -> DataFrame:
    """A streaming plan of rows (key, batch, place, other columns): batches of exactly ``batch_size`` rows of each key, numbered on and on from 0.

    The rows of a key follow each other by micro-batch, and in one by ``order_by``; the rest that fills no batch waits in the state. With ``idle_ms``, a key that has had no rows for so long
    gives its rest as a smaller batch (at the next micro-batch that Spark runs). A null key is a key. A task holds one key's rows of a micro-batch, whose size the source's options bound
    (``maxFilesPerTrigger``); ``key`` and ``order_by`` are names of columns.
    """
    if not source.isStreaming:
        raise ValueError("not a streaming source")
    if batch_size <= 0:
        raise ValueError("batches must have a positive size")
    if {"batch", "place"} & {c.lower() for c in source.columns}:
        raise ValueError("columns batch and place are given out")
    use_rocksdb(source.sparkSession)
    columns = [c for c in source.columns if c != key]
    rest = T.StructType([T.StructField(c, source.schema[c].dataType) for c in columns])
    out = T.StructType([T.StructField(key, source.schema[key].dataType), T.StructField("batch", T.LongType()), T.StructField("place", T.LongType()), *rest.fields])
    return source.groupBy(key).transformWithStateInPandas(_Batches(key, columns, order_by, batch_size, idle_ms, rest), out, "Append", "None" if idle_ms is None else "ProcessingTime")


class _Sessions(StatefulProcessor):
    def __init__(self, key: str, gap: int, delay: int):
        self.key, self.gap, self.delay = key, gap, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "first long, last long, n long, total double")
        self.seen = handle.getValueState("seen", "latest long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = self.seen.get()[0] if self.seen.exists() else None
        mark = None if latest is None else latest - self.delay
        late, late_total = 0, 0.0
        spans = [(a, b, int(n), float(x)) for a, b, n, x in self.open.get()] if self.open.exists() else []
        for part in rows:
            at, value = part["at"].to_numpy(), part["value"].to_numpy()
            if mark is not None:
                out = at < mark
                late, late_total = late + int(out.sum()), late_total + float(value[out].sum())
                at, value = at[~out], value[~out]
            spans = _joined([*spans, *zip(at.tolist(), at.tolist(), [1] * len(at), value.tolist(), strict=True)], self.gap)
        latest = max([x for x in (latest, *(b for _, b, _, _ in spans)) if x is not None], default=None)
        found = []
        if late:
            found.append(("late", None, None, late, late_total))
        still = []
        for a, b, n, x in spans:
            # nothing that comes can be joined to it any more
            if b + self.gap < latest - self.delay:
                found.append(("session", a, b, n, x))
            else:
                still.append((a, b, n, x))
        self.open.clear()
        if still:
            self.open.put(still)
        if latest is not None:
            self.seen.update((latest,))
        if found:
            yield pd.DataFrame({self.key: [key[0]] * len(found), **{c: pd.array([f[i] for f in found], kind) for i, (c, kind) in enumerate((("kind", "string"), ("first", "Int64"), ("last", "Int64"), ("n", "Int64"), ("total", "float64")))}})

    def close(self) -> None:
        pass


def _joined(spans: list[tuple[int, int, int, float]], gap: int) -> list[tuple[int, int, int, float]]:
    """Spans in order, those that are no more than ``gap`` apart as one."""
    out: list[tuple[int, int, int, float]] = []
    for a, b, n, x in sorted(spans):
        if out and a <= out[-1][1] + gap:
            p, q, m, y = out[-1]
            out[-1] = p, max(q, b), m + n, y + x
        else:
            out.append((a, b, n, x))
    return out


def sessions(source: DataFrame, key: str, time: str | Column, value: str | Column, gap: int, delay: int) -> DataFrame:
    """A streaming plan of rows (key, kind, first, last, n, total): each key's sessions, which are its rows with no more than ``gap`` microseconds between one and the next.

    A key's mark is ``delay`` before the latest time that it had in earlier micro-batches: rows before it are late, and counted in rows of kind ``late`` (a row for each micro-batch that has
    some) instead of in sessions. A session is given out once when the key's time has passed its end by gap and delay; what is open stays in the state, which holds a row for each open
    session, not the rows themselves. Rows that come late but before the mark's time join sessions, and may join two into one. Rows with a null time are left out; a null value counts as 0;
    a null key is a key.
    """
    if not source.isStreaming:
        raise ValueError("not a streaming source")
    if min(gap, delay) < 0:
        raise ValueError("a gap and a delay aren't negative")
    use_rocksdb(source.sparkSession)
    at = F.col(time) if isinstance(time, str) else time
    worth = F.col(value) if isinstance(value, str) else value
    rows = source.select(F.col(key), F.unix_micros(at).alias("at"), F.coalesce(worth.cast("double"), F.lit(0.0)).alias("value")).where("at is not null")
    out = T.StructType([T.StructField(key, source.schema[key].dataType), *T._parse_datatype_string("kind string, first long, last long, n long, total double").fields])
    return rows.groupBy(key).transformWithStateInPandas(_Sessions(key, gap, delay), out, "Append", "None")


def windows(source: DataFrame, time: str, size: str, keys: Sequence[str], aggregates: Sequence[Column], slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Aggregates over tumbling (or with ``slide`` sliding) windows of event time: rows (keys, start, stop, aggregates), on a table or a stream alike.

    On a stream a window is given out when the latest time seen has passed its end by ``delay``; rows that are later than that are left out. Rows with a null time are in no window.
    """
    if source.isStreaming:
        source = source.withWatermark(time, delay)
    at = F.window(time, size, slide) if slide else F.window(time, size)
    out = source.groupBy(at.alias("_window"), *keys).agg(*aggregates)
    return out.select(*keys, F.col("_window.start").alias("start"), F.col("_window.end").alias("stop"), *(c for c in out.columns if c not in ("_window", *keys)))
