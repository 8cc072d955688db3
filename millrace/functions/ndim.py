"""Ragged nested arrays as Column expressions: sizes, shapes, padding, resizing, reshaping, generation.

Everything is a higher-order function inside the JVM; depth is a Python number known when the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ndims(kind: T.DataType) -> int:
    """Nesting depth of a type; a string counts one dimension, its characters."""
    n = 0
    while isinstance(kind, T.ArrayType):
        kind, n = kind.elementType, n + 1
    return n + isinstance(kind, T.StringType)


def element_type(kind: T.DataType, depth: int = -1) -> T.DataType:
    """The type ``depth`` levels down, the innermost one for -1."""
    while depth and isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth - 1
    if depth > 0:
        raise ValueError("the type has fewer dimensions")
    return kind


def nested(kind: T.DataType, depth: int) -> T.DataType:
    """``kind`` inside ``depth`` levels of arrays."""
    for _ in range(depth):
        kind = T.ArrayType(kind)
    return kind


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flat(array: Column | str, depth: int) -> Column:
    """``depth`` levels joined into one; one level is the array itself."""
    out = col(array)
    for _ in range(depth - 1):
        out = F.flatten(out)
    return out


def sizes(array: Column | str, depth: int) -> Column:
    """For each of ``depth`` levels the list of its sizes in order."""
    a = col(array)
    levels = [F.array(F.size(a))]
    for k in range(1, depth):
        levels.append(F.transform(flat(a, k), F.size))
    return F.array(*levels)


def shape(array: Column | str, depth: int) -> Column:
    """Sizes of the first element at each level, zeros after an empty level."""
    out, here = [], col(array)
    for k in range(depth):
        out.append(F.coalesce(F.when(F.size(here) >= 0, F.size(here)), F.lit(0)))
        if k < depth - 1:
            here = F.get(here, F.lit(0))
    return F.array(*out)


def largest(array: Column | str, depth: int) -> list[Column]:
    """The largest size at each of ``depth`` levels."""
    a = col(array)
    out = [F.size(a)]
    for k in range(1, depth):
        out.append(F.coalesce(F.array_max(F.transform(flat(a, k), F.size)), F.lit(0)))
    return out


def filler(value: Column, widths: Sequence[Column]) -> Column:
    """``value`` repeated to the given widths, the outermost first."""
    for w in reversed(widths):
        value = F.array_repeat(value, w)
    return value


def pad_to(array: Column | str, widths: Sequence[Column], value: Column) -> Column:
    """The array with every level filled up to its width; levels below a filled place are filled as well."""
    a = col(array)
    inner = F.transform(a, lambda x: pad_to(x, widths[1:], value)) if len(widths) > 1 else a
    return F.concat(inner, F.array_repeat(filler(value, widths[1:]), F.greatest(widths[0] - F.size(a), F.lit(0))))


def mask_to(array: Column | str, widths: Sequence[Column]) -> Column:
    """True where ``pad_to`` keeps an element of the array, false where it fills."""
    a = col(array)
    inner = F.transform(a, lambda x: mask_to(x, widths[1:])) if len(widths) > 1 else F.transform(a, lambda x: F.lit(True))
    return F.concat(inner, F.array_repeat(filler(F.lit(False), widths[1:]), F.greatest(widths[0] - F.size(a), F.lit(0))))


def pad(array: Column | str, depth: int, value: Column) -> Column:
    """Every array of a level filled up with ``value`` to the level's largest size."""
    return pad_to(array, largest(array, depth), value)


def resize(array: Column | str, wanted: Column | str, depth: int, value: Column) -> Column:
    """Cut or fill at every level to the sizes in ``wanted``, one list for each level in order as ``sizes`` gives; new places of the last level get ``value``."""
    a, w = col(array), col(wanted)

    def at(x: Column, level: int, index: Column) -> Column:
        # `index`: which array of this level it is, counted over the whole value
        n = F.element_at(F.element_at(w, level + 1), index + 1)
        if level == depth - 1:
            return F.concat(F.slice(x, 1, n), F.array_repeat(value, F.greatest(n - F.size(x), F.lit(0))))
        before = F.aggregate(F.slice(F.element_at(w, level + 1), 1, index), F.lit(0), lambda s, y: s + y)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        empty = F.filter(F.get(x, F.lit(0)), lambda _: F.lit(False))
        none = F.array_repeat(value, F.lit(0))
        for _ in range(depth - level - 2):
            none = F.array_repeat(none, F.lit(0))
        return F.transform(places, lambda i: at(F.coalesce(F.get(x, i), empty, none), level + 1, before + i))

    return at(a, 0, F.lit(0))


def reshape(array: Column | str, new: Sequence[int], depth: int = 1) -> Column:
    """The elements of ``depth`` levels in order, in the shape ``new``; one size may be -1. A wrong number of elements raises."""
    if sum(n == -1 for n in new) > 1 or any(n < -1 or n == 0 for n in new):
        raise ValueError("sizes must be positive, and one at the most -1")
    f = flat(array, depth)
    known = 1
    for n in new:
        known *= n if n > 0 else 1
    ok = F.size(f) % known == 0 if -1 in new else F.size(f) == known
    f = F.when(ok, f).otherwise(F.raise_error(F.lit(f"the elements don't fit into the shape {tuple(new)}")))

    def chunk(x: Column, n: int) -> Column:
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / n).cast("int") - 1), lambda i: F.slice(x, i * n + 1, n))).otherwise(F.array(x))

    rest = list(new[1:])
    if -1 in rest:  # the outer sizes are known, so what is inside can be deduced only by counting from the outside
        k = len(new) - 1 - list(reversed(new)).index(-1)
        inside = 1
        for n in new[k + 1 :]:
            inside *= n
        outside = known // inside
        out = f
        for n in reversed(new[k + 1 :]):
            out = chunk(out, n)
        width = F.floor(F.size(f) / (outside * inside)).cast("int")
        whole = out
        out = F.transform(F.sequence(F.lit(0), F.lit(outside - 1)), lambda i: F.slice(whole, i * width + 1, width))
        for n in reversed(new[1:k]):
            out = chunk(out, n)
        return out
    for n in reversed(rest):
        f = chunk(f, n)
    return f


def same_size(*arrays: Column | str) -> Column:
    """Whether all arrays have one size; true for none or one."""
    out = F.lit(True)
    for a, b in zip(arrays[:-1], arrays[1:], strict=True):
        out = out & (F.size(col(a)) == F.size(col(b)))
    return out


def lift(fun: Callable[..., Column], arrays: Sequence[Column], depth: int) -> Column:
    """``fun`` over the elements ``depth`` levels down, several arrays walked together; arrays of different sizes raise."""
    if depth == 0:
        return fun(*arrays)
    first, rest = arrays[0], arrays[1:]
    if not rest:
        return F.transform(first, lambda x: lift(fun, [x], depth - 1))
    ok = same_size(*arrays)
    out = F.transform(first, lambda x, i: lift(fun, [x, *(F.get(r, i) for r in rest)], depth - 1))
    return F.when(ok, out).otherwise(F.raise_error(F.lit("the columns have different sizes")))


def generate(shape_of: Column | str, make: Callable[..., Column], depth: int, fresh: int) -> Column:
    """An array of the shape of ``shape_of``'s first ``depth`` levels; ``make`` gets the index path of the first ``fresh`` levels, deeper elements share its value."""

    def at(x: Column, level: int, path: list[Column]) -> Column:
        if level == depth:
            return make(*path)
        return F.transform(x, lambda y, i: at(y, level + 1, [*path, i] if level < fresh else path))

    return at(col(shape_of), 0, [])
