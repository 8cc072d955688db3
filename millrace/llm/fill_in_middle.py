"""Fill-in-the-middle forms of texts: a prefix, a middle and a suffix cut at units, written in one of two orders behind markers.

Units are found on big integers with one bit for each byte: ``bytes.translate`` turns a text into its mask of a class of bytes, shifted boolean operations
mark the last byte of each unit, ``bit_count`` gives the number of units, and halving the mask again and again finds the byte where the k-th one ends.
All of it is linear in the text's length and needs a few times its bytes.

Null texts count as empty, rows that repeat are cut alike, an empty table gives none, and the table's other columns don't matter, whatever they are called.
A null id is written as the empty text where a text's draws are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import arrow_map, pick

#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those that are cut at all, and of those the ones with the suffix first.
CUT, SUFFIX_FIRST = 90, 20


def _class(holds: Callable[[int], bool]) -> bytes:
    """A table for ``bytes.translate``: the digit 1 for bytes of a class, 0 for others."""
    return bytes(b"01"[holds(b)] for b in range(256))


_INSIDE = _class(lambda b: 0x80 <= b < 0xC0)
_WHITE = _class(lambda b: b == 32 or 9 <= b <= 13)
_LINE = _class(lambda b: b == 10)


def _mask(data: bytes, table: bytes) -> int:
    """A bit for each byte, the first byte's the highest."""
    return int(data.translate(table), 2)


def unit_ends(data: bytes, unit: str = "char") -> int:
    """The mask of the bytes that end a unit: a code point, a word with the white space after it, or a line with its end. Not for empty texts."""
    if unit == "char":
        # the next byte, seen by a shift, doesn't go on with the code point
        return ~(_mask(data, _INSIDE) << 1) & ((1 << len(data)) - 1)
    if unit == "word":
        white = _mask(data, _WHITE)
        return white & ~(white << 1) | 1
    if unit == "line":
        return _mask(data, _LINE) | 1
    raise ValueError("a unit is a char, a word or a line")


def end_of(mask: int, width: int, k: int) -> int:
    """The byte after the k-th set bit from the top of a mask of ``width`` bits; 0 for none."""
    if not k:
        return 0
    at = 0
    while width > 1:
        low = width >> 1
        high = mask >> low
        n = high.bit_count()
        if k <= n:
            mask, width = high, width - low
        else:
            k, at = k - n, at + width - low
            mask, width = mask & ((1 << low) - 1), low
    return at + 1


def draws(seed: str, doc_id: str) -> list[int]:
    """The first four 8-digit groups of the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def checked_markers(markers: Sequence[str]) -> tuple[str, str, str]:
    """Three different markers, each beginning with a character that no marker has again: so none can arise where a piece and a marker meet."""
    p, s, m = markers
    if len({p, s, m}) < 3 or any(not x or any(x[0] in y[1:] for y in markers) for x in markers):
        raise ValueError("markers must differ, and none may have again the character with which one begins")
    return p, s, m


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: str = "1", cut: int = CUT, suffix_first: int = SUFFIX_FIRST, markers: Sequence[str] = MARKERS) -> DataFrame:
    """Rows (doc_id, n, form, prefix_units, middle_units, output) of every text, ``n`` being its units.

    ``form`` is plain (empty texts, texts that hold a marker, and ``100 - cut`` of 100 others: the output is the text, and there are no sizes), psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle; ``suffix_first`` of 100). All draws come from the digest of seed and id, so rows of one id are cut by the same numbers.
    """
    p, s, m = (x.encode() for x in checked_markers(markers))
    kind = df.schema[id_col].dataType.simpleString()
    rows = pick(df, id_col, text_col).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def one(text: bytes, key: str) -> tuple[int, str, int | None, int | None, bytes]:
        mask = unit_ends(text, unit) if text else 0
        n = mask.bit_count()
        h1, h2, h3, h4 = draws(seed, key)
        if not text or p in text or s in text or m in text or h3 % 100 >= cut:
            return n, "plain", None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        x, y = end_of(mask, len(text), a), end_of(mask, len(text), b)
        prefix, middle, suffix = text[:x], text[x:y], text[y:]
        if h4 % 100 < suffix_first:
            return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
        return n, "psm", a, b - a, p + prefix + s + suffix + m + middle

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [one(t.as_buffer().to_pybytes() if t.is_valid else b"", k) for t, k in zip(batch.column("text"), batch.column("key").to_pylist(), strict=True)]
            columns = zip(*got, strict=True)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            made[-1] = made[-1].cast(pa.string())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

        return run

    return arrow_map(rows, make, f"doc_id {kind}, n long, form string, prefix_units long, middle_units long, output string", "text")


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output and its form stand for."""
    p, s, m = checked_markers(markers)
    at_p, at_s, at_m = (F.instr(output, x) for x in (p, s, m))

    def between(start: Column, end: Column) -> Column:
        return F.substring(output, start, end - start)

    last = F.substring(output, at_m + len(m), F.char_length(output))
    psm = F.concat(between(at_p + len(p), at_s), last, between(at_s + len(s), at_m))
    spm = F.concat(between(at_p + len(p), at_m), last, between(at_s + len(s), at_p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
