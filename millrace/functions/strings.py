"""Text conversion and base64 as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that are read as booleans.
TRUE = ("true", "True", "TRUE", "1", "y", "Y", "yes", "Yes", "YES", "on", "On", "ON")
FALSE = ("false", "False", "FALSE", "0", "n", "N", "no", "No", "NO", "off", "Off", "OFF")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base64_encode(data: Column | str) -> Column:
    """Standard alphabet with padding in one line."""
    return F.regexp_replace(F.base64(col(data).cast("binary")), "\r\n", "")


def base64_decode(text: Column | str) -> Column:
    """Bytes of base64 text, padded or not; malformed text raises."""
    return F.unbase64(F.rtrim(col(text), F.lit("=")))


def string_to(text: Column | str, kind: str) -> Column:
    """A strict cast: text with white space around it, or that doesn't convert, raises; ``boolean`` reads the words of TRUE and FALSE."""
    t = col(text)
    if kind == "string":
        return t
    if kind in ("boolean", "bool"):
        return string_to_bool(t)
    fail = F.raise_error(F.concat(F.lit(f"not a {kind}: "), F.coalesce(t, F.lit("null"))))
    return F.when(t == F.trim(t), t.cast(kind)).when(t.isNull(), F.lit(None).cast(kind)).otherwise(fail.cast(kind))


def string_to_bool(text: Column | str) -> Column:
    """Booleans from the usual words, trailing spaces allowed; other text raises."""
    t = col(text)
    word = F.rtrim(t)
    fail = F.raise_error(F.concat(F.lit("not a boolean: "), t))
    return F.when(word.isin(*TRUE), F.lit(True)).when(word.isin(*FALSE), F.lit(False)).when(t.isNull(), F.lit(None).cast("boolean")).otherwise(fail.cast("boolean"))


def to_string(value: Column | str) -> Column:
    """Text of a value; booleans as true and false."""
    return col(value).cast("string")


def characters(text: Column | str) -> Column:
    """The characters (code points) of a text as an array."""
    return F.when(F.char_length(col(text)) == 0, F.array().cast("array<string>")).otherwise(F.split(col(text), "", -1))


def joined(chars: Column) -> Column:
    """The text of an array of characters."""
    return F.array_join(chars, "")


def map_characters(text: Column | str, fun) -> Column:
    """``fun`` over the characters (code points) of a text."""
    return F.when(F.char_length(col(text)) == 0, col(text)).otherwise(F.array_join(F.transform(F.split(col(text), "", -1), fun), ""))
