"""Driver threads for Spark jobs that don't depend on each other; the executors' work is Spark's to schedule."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any


class ThreadPool:
    """Runs functions in threads, as many as this machine has cores, one at least; leaving it waits for all."""

    def __init__(self, threads: int | None = None):
        self._pool = ThreadPoolExecutor(max(1, threads or os.cpu_count() or 1))

    def enqueue(self, fun: Callable[..., Any], *args: Any) -> Future:
        return self._pool.submit(fun, *args)

    def map(self, fun: Callable[[Any], Any], values: Iterable[Any]) -> list:
        return list(self._pool.map(fun, values))

    def __enter__(self) -> ThreadPool:
        return self

    def __exit__(self, *_: Any) -> None:
        self._pool.shutdown(wait=True)
