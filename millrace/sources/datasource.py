"""The strict CSV dialect as a Spark data source, for ``spark.read``, ``spark.readStream`` and SQL.

    register(spark)
    spark.read.format("strict_csv").option("sep", ";").load("folder or files")
    spark.readStream.format("strict_csv").schema("a string, b string").load("folder")

A task reads one file, row by row, and holds no more than the rows of one Arrow batch and the row at hand; ``read_csv`` cuts large files in pieces. Files are opened by pyarrow, so the path is one that
driver and executors both reach (a shared folder, or a store that pyarrow knows). All columns are strings. Without a schema the names come from the first file's header, or are c0, c1, ... without one.

Options: ``header`` (true), ``sep``, ``quote``, ``escape``, ``drop`` (rows before the header), ``maxFilesPerTrigger`` (streams). A row of another size than the schema, another header and a quote without an
end raise; a folder without files gives an empty table if there is a schema. Empty fields are empty texts. Files whose names begin with a point or an underscore aren't read.

A stream's offset is the last file's time and name: files must come in this order, as those do that are moved to the folder when they are complete. A query that is started again reads the files after
its checkpoint's offset.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from millrace.sources.csv import CsvError, Dialect, parse_rows

#: Rows of an Arrow batch.
ROWS = 4096


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[int, str]]:
    """(time, path) of the files at a path, in order."""
    where, at = _place(path)
    found = where.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [found] if found.is_file else where.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((x.mtime_ns or 0, prefix + x.path) for x in infos if x.is_file and not x.base_name.startswith((".", "_")))


def rows_of(path: str, dialect: Dialect) -> Iterator[list[str]]:
    """The rows of a file, which is read as a stream: lines are joined as long as a quoted field goes on."""
    where, at = _place(path)
    with where.open_input_stream(at) as raw, io.TextIOWrapper(io.BufferedReader(raw), "utf-8", newline="\n") as text:
        held, inside = [], False
        for line in text:
            inside = dialect.inside(line.rstrip("\n"), inside)
            held.append(line)
            if not inside:
                yield from parse_rows("".join(held), dialect.separator, dialect.quote, dialect.escape)
                held = []
        if held:
            raise CsvError("a quoted field doesn't end")


@dataclass
class _File(InputPartition):
    path: str


class _Options:
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        if "path" not in low:
            raise ValueError("strict_csv needs a path")
        self.path, self.drop = low["path"], int(low.get("drop", 0))
        self.header = low.get("header", "true").lower() == "true"
        self.dialect = Dialect(low.get("sep", ","), low.get("quote", '"'), low.get("escape", "\\"))
        self.most = int(low.get("maxfilespertrigger", 0))

    def table(self, path: str) -> tuple[list[str] | None, Iterator[list[str]]]:
        rows = rows_of(path, self.dialect)
        for _ in range(self.drop):
            next(rows, None)
        if not self.header:
            return None, rows
        head = next(rows, None)
        if head is None:
            raise CsvError(f"there is no header in {path}")
        return head, rows

    def batches(self, path: str, schema: T.StructType) -> Iterator[pa.RecordBatch]:
        names = schema.names
        head, rows = self.table(path)
        if head is not None and head != names:
            raise CsvError(f"the header of {path} is {head} instead of {names}")
        held = []
        for i, r in enumerate(rows):
            if len(r) != len(names):
                raise CsvError(f"row {i} of {path} has {len(r)} fields instead of {len(names)}")
            held.append(r)
            if len(held) == ROWS:
                yield self._batch(held, names)
                held = []
        if held:
            yield self._batch(held, names)

    @staticmethod
    def _batch(rows: list[list[str]], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)


class StrictCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strict_csv"

    def schema(self) -> T.StructType:
        o = _Options(self.options)
        files = files_of(o.path)
        if not files:
            raise ValueError(f"there is no file in {o.path}; give a schema")
        head, rows = o.table(files[0][1])
        names = head if head is not None else [f"c{i}" for i in range(len(next(rows, [])))]
        if len(set(names)) != len(names):
            raise CsvError(f"names repeat in the header {names}")
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(_Options(self.options), _strings(schema))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(_Options(self.options), _strings(schema))


def _strings(schema: T.StructType) -> T.StructType:
    if any(not isinstance(f.dataType, T.StringType) for f in schema.fields):
        raise TypeError("all columns of strict_csv are strings; cast them afterwards")
    return schema


class _Reader(DataSourceReader):
    def __init__(self, options: _Options, schema: T.StructType):
        self.options, self.kinds = options, schema

    def partitions(self) -> list[InputPartition]:
        return [_File(path) for _, path in files_of(self.options.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return self.options.batches(partition.path, self.kinds) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: _Options, schema: T.StructType):
        self.options, self.kinds, self.last = options, schema, None

    @staticmethod
    def _of(offset: dict) -> tuple[int, str]:
        return int(offset["time"]), offset["name"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": "-1", "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        seen = self.last or (-1, "")
        new = [f for f in files_of(self.options.path) if f > seen]
        if self.options.most:
            new = new[: self.options.most]
        time, name = new[-1] if new else seen
        self.last = (time, name)
        return {"time": str(time), "name": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = self._of(start), self._of(end)
        self.last = max(self.last or b, b)
        return [_File(path) for time, path in files_of(self.options.path) if a < (time, path) <= b]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return self.options.batches(partition.path, self.kinds)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Makes the format ``strict_csv`` known to a session."""
    spark.dataSource.register(StrictCsv)
