"""CSV text in a strict dialect: a parser that reads files in pieces, a writer of column expressions, and Spark's own reader as the fast way.

The dialect: blanks before a field are skipped; a field whose first character is the quote ends at the next quote that isn't escaped, and what
follows up to the separator is dropped; the escape makes any next character literal; other fields lose white space around them; blank
lines are skipped; every row must have as many fields as the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.frame import TextTable
from millrace.operators.layout import POS, numbered

BLANK = " \t"
SPACE = " \t\n\v\f\r"


class CsvError(ValueError):
    pass


@dataclass(frozen=True)
class Dialect:
    """Separator, quote and escape, one character each, and what is found with them."""

    separator: str = ","
    quote: str = '"'
    escape: str = "\\"

    @cached_property
    def field(self) -> re.Pattern:
        """A field and what ends it: group 1 is a quoted field's content, group 2 another field, group 3 the separator, or nothing at a row's end."""
        s, q, e = map(re.escape, (self.separator, self.quote, self.escape))
        return re.compile(rf"[ \t]*+(?:{q}((?:[^{q}{e}]|{e}.)*+){q}[^{s}\n]*+|(?!{q})([^{s}\n]*+))({s}?)", re.DOTALL)

    @cached_property
    def rest(self) -> re.Pattern:
        """What is left of a quoted field, with the quote."""
        q, e = map(re.escape, (self.quote, self.escape))
        return re.compile(rf"(?:[^{q}{e}]|{e}.)*+{q}", re.DOTALL)

    @cached_property
    def escaped(self) -> re.Pattern:
        return re.compile(rf"{re.escape(self.escape)}(.)", re.DOTALL)

    def fields(self, text: str, at: int = 0) -> tuple[list[str], int]:
        """The fields of the row that begins at ``at``, and where it ends."""
        out, match = [], self.field.match
        while True:
            m = match(text, at)
            if m is None:
                raise CsvError("a quoted field doesn't end")
            inner = m[1]
            if inner is None:
                out.append(m[2].strip(SPACE))
            else:
                out.append(self.escaped.sub(r"\1", inner) if self.escape in inner else inner)
            at = m.end()
            if not m[3]:
                return out, at

    def inside(self, line: str, inside: bool) -> bool:
        """Whether the end of a line, which has no line end in it, is in a quoted field, if its begin is (``inside``), or else is a row's begin."""
        if self.quote not in line:
            return inside
        at, n = 0, len(line)
        if not inside:
            while at < n and line[at] in SPACE:
                at += 1
        while True:
            if inside:
                m = self.rest.match(line, at)
                if m is None:
                    return True
                at, inside = m.end(), False
            else:
                while at < n and line[at] in BLANK:
                    at += 1
                if at < n and line[at] == self.quote:
                    at, inside = at + 1, True
                    continue
            at = line.find(self.separator, at) + 1
            if not at:
                return False


def parse_rows(text: str, separator: str = ",", quote: str = '"', escape: str = "\\") -> Iterator[list[str]]:
    """The rows of a text one after another."""
    dialect, at, n = Dialect(separator, quote, escape), 0, len(text)
    while True:
        while at < n and text[at] in SPACE:
            at += 1
        if at == n:
            return
        row, at = dialect.fields(text, at)
        yield row


def parse_table(text: str, drop: int = 0, has_header: bool = True, separator: str = ",", quote: str = '"', escape: str = "\\") -> tuple[list[str] | None, list[list[str]]]:
    """Header (or None) and rows of a text after ``drop`` parsed rows."""
    rows = list(parse_rows(text, separator, quote, escape))[drop:]
    header = None
    if has_header:
        if not rows:
            raise CsvError("there is no header")
        header, rows = rows[0], rows[1:]
    width = len(header) if header is not None else len(rows[0]) if rows else 0
    for i, r in enumerate(rows):
        if len(r) != width:
            raise CsvError(f"row {i} has {len(r)} fields instead of {width}")
    return header, rows


def read_csv_text(spark: SparkSession, text: str, drop: int = 0, has_header: bool = True, separator: str = ",", quote: str = '"', escape: str = "\\") -> TextTable:
    """A table of a text on the host."""
    header, rows = parse_table(text, drop, has_header, separator, quote, escape)
    width = len(header) if header is not None else len(rows[0]) if rows else 0
    schema = ", ".join([f"{POS} long", *(f"c{i} string" for i in range(width))])
    return TextTable(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema), header)


def read_csv(spark: SparkSession, path: str, drop: int = 0, has_header: bool = True, separator: str = ",", quote: str = '"', escape: str = "\\") -> TextTable:
    """A table of a file or of all files of a folder, in the order of their names.

    Files are read in pieces, as Spark splits them at line ends. A first pass tells for each piece whether its end is in a quoted field, for either state of its begin; from these
    the driver knows the state at each begin, and a second pass parses every piece by itself, row by row. Rows that reach over pieces come out in parts, which are joined.
    The rows that are dropped and the header must lie in a file's first piece.
    """
    dialect = Dialect(separator, quote, escape)
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    begins, ranks = _begins(lines, dialect)
    known = spark.sparkContext.broadcast((begins, ranks))
    head = _first_row(lines, min(ranks), drop, dialect) if ranks else None
    if has_header and head is None:
        raise CsvError("there is no header")
    width, expected = len(head) if head is not None else 0, head if has_header else None
    skipped = drop + has_header
    columns = [f"c{i}" for i in range(width)]

    def whole(names: list[int], blocks: list[int], numbers: list[int], rows: list[list[str]], parts: list[str | None]) -> pa.RecordBatch:
        cells = [pa.array([r[i] if r is not None else None for r in rows], pa.string()) for i in range(width)]
        keys = [pa.array(names, pa.int32()), pa.array(blocks, pa.int64()), pa.array(numbers, pa.int64()), pa.array(parts, pa.string())]
        return pa.RecordBatch.from_arrays([*keys, *cells], ["file", "block", "line", "part", *columns])

    def fields(text: str) -> list[str]:
        row, at = dialect.fields(text)
        if text[at:].strip(SPACE):
            raise CsvError("a row doesn't end with its line")
        return row

    def checked(row: list[str]) -> list[str]:
        if len(row) != width:
            raise CsvError(f"a row has {len(row)} fields instead of {width}")
        return row

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, ranks = known.value
        for file, block, texts in _pieces(batches):
            rank, owner, number = ranks[file], begins.get((file, block)), 0
            out: list[tuple[int, int, int, list[str] | None, str | None]] = []
            inside = owner is not None
            held = [] if inside else None  # the lines of a row that isn't at its end
            for line in texts:
                if held is None and not line.strip(SPACE):
                    continue
                inside = dialect.inside(line, inside)
                if held is not None:
                    held.append(line)
                    if inside:
                        continue
                    line, held = "\n".join(held), None
                    if owner is not None:  # the end of a row of an earlier piece
                        out.append((rank, owner, block, None, line))
                        owner = None
                        continue
                elif inside:
                    held = [line]
                    continue
                row = fields(line.lstrip(SPACE))
                number += 1
                if block or number > skipped:
                    out.append((rank, block, number, checked(row), None))
                elif number == skipped and has_header and row != expected:
                    raise CsvError(f"the files differ in their columns: {file}")
                if len(out) == 20_000:
                    yield whole(*zip(*out, strict=True))
                    out = []
            if held is not None:  # it goes on in the next piece, or began in an earlier one and still isn't at its end
                if not block and number < skipped:
                    raise CsvError(f"what is dropped of a file and its header don't lie in its first piece: {file}")
                out.append((rank, block if owner is None else owner, block if owner is not None else -1 - number, None, "\n".join(held)))
            elif not block and number < skipped and has_header:
                raise CsvError(f"what is dropped of a file and its header don't lie in its first piece: {file}")
            if out:
                yield whole(*zip(*out, strict=True))

    schema = ", ".join(["file int", "block long", "line long", "part string", *(f"{c} string" for c in columns)])
    parsed = lines.mapInArrow(parse, schema)
    rows = parsed.where("part is null").select("file", "block", "line", *columns)
    if begins:

        def join(key, frame):
            import pandas as pd

            frame = frame.sort_values("line")
            first = frame["line"].iloc[0]
            if first >= 0:
                raise CsvError("a row's begin is missing")
            row = checked(fields("\n".join(frame["part"]).lstrip(SPACE)))
            return pd.DataFrame([[*key, -first, *row]], columns=["file", "block", "line", *columns])

        parts = parsed.where("part is not null").select("file", "block", "line", "part")
        rows = rows.unionAll(parts.groupBy("file", "block").applyInPandas(join, rows.schema))
    return TextTable(numbered(rows, ["file", "block", "line"]).select(POS, *columns), head if has_header else None)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(file, block, its lines) of each piece in rows (file, block, value), of which those of a piece follow one another. Lines must be read before the next piece is asked for."""

    def rows() -> Iterator[tuple[tuple[str, int], str]]:
        for b in batches:
            yield from zip(zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True), b.column("value").to_pylist(), strict=True)

    for (file, block), group in groupby(rows(), key=lambda r: r[0]):
        yield file, block, (line for _, line in group)


def _begins(lines: DataFrame, dialect: Dialect) -> tuple[dict[tuple[str, int], int], dict[str, int]]:
    """For each piece (file, block) that begins in a quoted field, the block in which its row began; and each file's number in the order of names. The driver gets a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, texts in _pieces(batches):
            out, within, ended = False, True, False
            for line in texts:
                if dialect.quote in line:
                    out, within = dialect.inside(line, out), dialect.inside(line, within)
                ended |= not within
            schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("out", pa.bool_()), ("within", pa.bool_()), ("ended", pa.bool_())])
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "out": [out], "within": [within], "ended": [ended]}, schema)

    begins: dict[tuple[str, int], int] = {}
    ranks: dict[str, int] = {}
    inside, owner = False, 0
    for r in sorted(lines.mapInArrow(run, "file string, block long, out boolean, within boolean, ended boolean").collect(), key=lambda r: (r["file"], r["block"])):
        if r["file"] not in ranks:
            if inside:
                raise CsvError("a quoted field doesn't end")
            ranks[r["file"]] = len(ranks)
        if inside:
            begins[r["file"], r["block"]] = owner
        if not inside or r["ended"]:  # a row that is open at the end began here
            owner = r["block"]
        inside = r["within"] if inside else r["out"]
    if inside:
        raise CsvError("a quoted field doesn't end")
    return begins, ranks


def _first_row(lines: DataFrame, file: str, drop: int, dialect: Dialect) -> list[str] | None:
    """The first row after ``drop`` rows of a file. The driver reads as many lines of its first piece as that takes."""
    begin, n = lines.where((F.col("file") == file) & (F.col("block") == 0)).select("value"), 100 + drop
    while True:
        got = [r["value"] for r in begin.limit(n).collect()]
        rows: list[list[str]] = []
        try:
            for row in islice(parse_rows("\n".join(got), dialect.separator, dialect.quote, dialect.escape), drop + 1):
                rows.append(row)
        except CsvError:  # the lines end within a row
            pass
        if len(got) < n or len(rows) > drop:
            return rows[drop] if len(rows) > drop else None
        n *= 100


def read_csv_fast(spark: SparkSession, path: str, has_header: bool = True, separator: str = ",", quote: str = '"', escape: str = "\\") -> DataFrame:
    """Spark's own splittable reader as strings: for files without line ends in fields. Empty fields are empty texts; rows of other sizes raise."""
    df = spark.read.csv(path, header=has_header, sep=separator, quote=quote, escape=escape, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST", emptyValue="")
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def quoted(field: Column, separator: str = ",", quote: str = '"', escape: str = "\\") -> Column:
    """A field as the writer puts it: in quotes if it has a separator, a quote or a line end, or white space at an end."""
    odd = F.contains(field, F.lit(separator)) | F.contains(field, F.lit(quote)) | F.contains(field, F.lit("\n")) | field.rlike(r"^[ \t\n\x0b\f\r]|[ \t\n\x0b\f\r]$")
    safe = F.replace(F.replace(field, F.lit(escape), F.lit(escape * 2)), F.lit(quote), F.lit(escape + quote))
    return F.when(odd, F.concat(F.lit(quote), safe, F.lit(quote))).otherwise(field)


def csv_line(fields: Sequence[Column], separator: str = ",", quote: str = '"', escape: str = "\\") -> Column:
    """A row's text without its line end."""
    return F.concat_ws(separator, *(quoted(f, separator, quote, escape) for f in fields))


def write_csv_row(fields: Sequence[str], separator: str = ",", quote: str = '"', escape: str = "\\") -> str:
    """A row's text on the host, with its line end."""
    out = []
    for f in fields:
        if any(c in f for c in (separator, quote, "\n")) or f[:1] in SPACE and f or f[-1:] in SPACE and f:
            f = quote + f.replace(escape, escape * 2).replace(quote, escape + quote) + quote
        out.append(f)
    return separator.join(out) + "\n"


def csv_text(table: TextTable, separator: str = ",", quote: str = '"', escape: str = "\\") -> str:
    """The table's text on the host: the header, if there is one, then the rows."""
    head = write_csv_row(table.header(), separator, quote, escape) if table.names else ""
    return head + "".join(write_csv_row(r, separator, quote, escape) for r in table.raw_rows())


def write_csv(table: TextTable, path: str, separator: str = ",", quote: str = '"', escape: str = "\\", single: bool = True) -> None:
    """Writes a folder of text: one file in row order, or without ``single`` as many as there are partitions (each with the header)."""
    lines = table.df.select(POS, csv_line([F.col(c) for c in table.columns], separator, quote, escape).alias("value"))
    if table.names:
        head = write_csv_row(table.header(), separator, quote, escape)[:-1]
    if single:
        if table.names:
            lines = lines.unionAll(table.df.sparkSession.createDataFrame([(-1, head)], f"{POS} long, value string"))
        lines.repartition(1).sortWithinPartitions(POS).select("value").write.text(path)
        return
    parts = lines.repartitionByRange(int(table.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), POS).sortWithinPartitions(POS)
    if table.names:

        def headed(frames):
            import pandas as pd

            started = False
            for pdf in frames:
                if not started:
                    yield pd.DataFrame({"value": [head]})
                    started = True
                yield pdf[["value"]]

        parts = parts.mapInPandas(headed, "value string")
    parts.select("value").write.text(path)
