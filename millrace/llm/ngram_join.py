"""Similarity join on word n-grams: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

Documents become sets of 64-bit shingle hashes; equal sets form one class (a 128-bit digest of the set, of which 64 bits name it unless
another class has the same). Only class members of the smallest ids take part in the join, so exact copies are never paired.

1. One pass gives each document's class and a count sketch of shingles (two rows of ``1 << BUCKET_BITS`` buckets), summed over all documents.
2. A second pass orders each set by the smaller of its buckets' counts over their row's median, then hash, and posts its prefix. Any fixed order gives
   whole results; counts only make lists short. The median is what shingles that are nowhere frequent fill a bucket with at any size of input, so what
   stands out over it is a list's own length.
3. Lists are read as a sorted stream, the token's foremost positions first: of near copies, the one without rare edits leads. Round one pairs every
   member with the list's first and with the one before it, so a list of m near copies costs m steps. Candidates that
   pass the filters are verified on whole sets and joined to components.
4. Round two takes the lists that still hold several components and pairs each member with the nearest one of each other component. The last
   round takes what is still apart and pairs members of different components in all, so what it leaves apart has no link.

The suffix filter bounds the sets' difference from below: by the difference of their histograms over ``CELLS`` hash cells in
round one, and from then on by their parity sketches of ``SKETCH`` bits as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import SLICE, arrow_map, buffer_of, chunks, forget, mixed, release, shingle_hashes, table_rows, table_sum, unused, word_hashes, written

#: Bits of a bucket's number in each row of the count sketch; the scale's middle, which is the median bucket, and its steps for each doubling of what a bucket has more.
BUCKET_BITS = 19
MIDDLE = 2048
STEPS = 48
#: Bits of the filter of documents whose sets are fetched, and the classes up to which it parts them; more are fetched by a join.
BLOOM_BITS = 23
FETCHED = 1_000_000
#: Members of a list that meet in a task when lists of several components are told.
MEET = 1000
#: Bits of the number that names a class.
KEY_BITS = 64
CELLS = 16
#: Bits of a set's sketch: for each hash cell, whether it holds an odd number of the set's shingles.
SKETCH = 1024
#: Lists of up to so many members are looked through at once: members that pass the filters with no other one leave them.
SHORT = 128
#: Members (by the count sketch, over its median) from which on a token's list is dealt to several tasks in round one, and members from which on a list is cut into cells later.
HOT = 200_000
CELL = 20_000

_U = np.uint64


def unique_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, and its bounds in them (texts + 1)."""
    words, _, _, first = word_hashes(raw, offsets)
    h, bounds = shingle_hashes(words, first, width)
    edges = bounds.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        h[a:b].sort()
    if not len(h):
        return h, bounds
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][bounds[:-1] < len(h)]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def class_keys(h: np.ndarray, bounds: np.ndarray, bits: int, renamed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """A digest of each set, in two 64-bit numbers: the one that names its class (of ``bits`` bits; 0 for an empty set) and another.

    ``renamed``: names that several classes would have; these are named by the other number. Without it being of use the other number isn't computed."""
    n = np.diff(bounds)

    def digest(seed: int) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed(h ^ _U(seed)), dtype=_U)])
        return mixed(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(_U))

    keys = np.where(n > 0, digest(0x5851F42D4C957F2D) >> _U(64 - bits) | _U(1), _U(0)).view(np.int64)
    if renamed is not None and not len(renamed):
        return keys, None
    other = np.where(n > 0, digest(0x2545F4914F6CDD1D) | _U(1), _U(0)).view(np.int64)
    return (keys if renamed is None else np.where(np.isin(keys, renamed), other, keys)), other


def buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's bucket in either row of the count sketch."""
    return (h >> _U(64 - BUCKET_BITS)).astype(np.int64), (h >> _U(12) & _U((1 << BUCKET_BITS) - 1)).astype(np.int64)


def sketches(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity sketches: two of them differ in as many bits at most as their sets have different members."""
    n = len(bounds) - 1
    cells = np.bincount(np.repeat(np.arange(n), np.diff(bounds)) * SKETCH + (h >> _U(8) & _U(SKETCH - 1)).astype(np.int64), minlength=n * SKETCH)
    return [x.tobytes() for x in np.packbits((cells & 1).astype(bool).reshape(n, SKETCH), axis=1)]


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of ``n`` of which any similar set shares one at least."""
    return n - -(-percent * n // 100) + 1


def overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of similar sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


def classes_and_counts(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, mark, n_shingles, key, other, sketch) of documents (doc_id, mark, text) and, from each task, rows (slice, counts) of its count sketch."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "mark")}
    bits = KEY_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        schema = None
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                h, bounds = unique_sets(*buffer_of(part.column("text")), width)
                for row, at in zip(counts, buckets(h), strict=True):
                    row += np.bincount(at, minlength=len(row))
                n = np.diff(bounds)
                none = pa.nulls(len(n))
                schema = pa.schema(
                    [("doc_id", part.column("doc_id").type), ("mark", part.column("mark").type), ("n_shingles", pa.int64()), ("key", pa.int64()), ("other", pa.int64()),
                     ("sketch", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array(n), *map(pa.array, class_keys(h, bounds, bits)), pa.array(sketches(h, bounds), pa.binary()),
                     none.cast(pa.int32()), none.cast(pa.binary())], schema=schema
                )
        if schema is not None:
            rows = table_rows(counts, "<u4")
            for at in range(0, rows.num_rows, 256):
                r = rows.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(r.num_rows, f.type) for f in list(schema)[:-2]), *r.columns], schema=schema)

    return docs.select("doc_id", "mark", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, mark {kinds['mark']}, n_shingles long, key long, other long, sketch binary, slice int, counts binary")


def scale_of(counts: np.ndarray) -> np.ndarray:
    """For each bucket of a row, 12 bits that rise with its count: ``MIDDLE`` for the median, then on a logarithmic scale of the distance to it."""
    over = counts - np.median(counts)
    return (MIDDLE + np.sign(over) * np.log2(1 + np.abs(over)) * STEPS).clip(0, 4095).astype(np.uint64)


POSTING = "token long, key long, place long, cells0 long, cells1 long"


def postings(docs: DataFrame, width: int, percent: int, counts: np.ndarray, renamed: np.ndarray) -> DataFrame:
    """token, key, place (position << 36 | set size), histogram: the prefix of each set, rare tokens first.

    A token is 12 bits of the smaller of its buckets' scales, then 52 bits of its hash.
    """
    scale = docs.sparkSession.sparkContext.broadcast(np.stack([scale_of(row) for row in counts]) << _U(52))
    bits = KEY_BITS

    def make():
        rank, known = scale.value, set()

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            h, bounds = unique_sets(*buffer_of(batch.column("text")), width)
            n, keys = np.diff(bounds), class_keys(h, bounds, bits, renamed)[0]
            one, two = buckets(h)
            tokens = np.minimum(rank[0][one], rank[1][two]) | h >> _U(12)
            which = np.repeat(np.arange(len(n)), n)
            cells = np.bincount(which * CELLS + (h & _U(CELLS - 1)).astype(np.int64), minlength=len(n) * CELLS).clip(max=255).astype(np.uint8).view(np.int64).reshape(-1, 2)
            take = np.minimum(n, prefix(n, percent))
            edges, out, rows = bounds.tolist(), [], []
            for i, (a, b, p, key) in enumerate(zip(edges[:-1], edges[1:], take.tolist(), keys.tolist(), strict=True)):
                if a < b and key not in known:
                    if len(known) < 100_000:
                        known.add(key)
                    x = tokens[a:b]
                    if p < b - a:
                        x = np.partition(x, p - 1)[:p]
                    x.sort()
                    out.append(x)
                    rows.append(i)
            if not out:
                return None
            rows = np.array(rows)
            m = take[rows]
            at = np.repeat(rows, m)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            columns = np.concatenate(out).view(np.int64), keys[at], pos << 36 | n[at], cells[at, 0], cells[at, 1]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["token", "key", "place", "cells0", "cells1"])

        return part

    return arrow_map(docs.select("text"), make, POSTING, "text")


def hot_scale(most: int) -> int:
    """The first 12 bits of tokens in more than ``most`` documents are larger than this."""
    return int(MIDDLE + np.log2(1 + most) * STEPS)


def parts_of(token: Column, most: int) -> Column:
    """In how many parts a token's list is dealt: so many that a part has ``most`` members at the most, by the count sketch."""
    scale = F.shiftrightunsigned(token, 52)
    return F.when(scale > hot_scale(most), F.ceil(F.pow(F.lit(2.0), (scale - MIDDLE) / STEPS) / most).cast("long")).otherwise(F.lit(1).cast("long"))


def dealt(token: Column, key: Column, most: int) -> Column:
    """The number of a member's part of its token's list."""
    parts = parts_of(token, most)
    return F.when(parts > 1, F.pmod(F.xxhash64(key), parts)).otherwise(F.lit(0).cast("long"))


class Rows:
    """Postings as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.cols = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        self._parts()

    def _parts(self) -> None:
        c = self.cols
        self.token, self.key = c["token"], c["key"]
        self.n, self.pos = c["place"] & ((1 << 36) - 1), c["place"] >> 36
        self.cells = np.stack([c["cells0"], c["cells1"]], axis=1).view(np.uint8).astype(np.int16)

    def take(self, at) -> Rows:
        out = object.__new__(Rows)
        out.cols = {k: v[at] for k, v in self.cols.items()}
        out._parts()
        return out

    def __add__(self, other: Rows) -> Rows:
        out = object.__new__(Rows)
        out.cols = {k: np.concatenate([v, other.cols[k]]) for k, v in self.cols.items()}
        out._parts()
        return out

    def similar(self, i, j, percent: int) -> np.ndarray:
        """Which of the pairs of rows pass the length, positional and suffix filters."""
        n, m = self.n[i], self.n[j]
        need = overlap(n, m, percent)
        ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (1 + np.minimum(n - self.pos[i], m - self.pos[j]) - 1 >= need) & (self.key[i] != self.key[j])
        near = np.abs(self.cells[i] - self.cells[j]).sum(axis=-1) <= n + m - 2 * need
        return ok & near


def first_round(posted: DataFrame, percent: int) -> DataFrame:
    """Reads the lists of tokens: rows (a, b) with place null are candidate pairs; the others are postings of lists of two classes or more (a: token, b: key), without
    the members of short lists that the filters part from all others."""

    top = hot_scale(HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: Rows | None = None  # the first row of the list that the rows before ended in, and its last row if there is another
        for batch in batches:
            rows = Rows(batch)
            skip = 0
            if held is not None:
                skip, rows = len(held.key), held + rows
            same = np.zeros(len(rows.key), bool)
            same[1:] = (rows.token[1:] == rows.token[:-1]) & (rows.key[1:] == rows.key[:-1])
            if same.any():  # copies from several tasks
                rows = rows.take(np.flatnonzero(~same))
            count = len(rows.key)
            index = np.arange(count)
            begins = np.ones(count, bool)
            begins[1:] = rows.token[1:] != rows.token[:-1]
            start = np.maximum.accumulate(np.where(begins, index, 0))
            follow = np.flatnonzero(~begins & (index >= skip))
            hub, before = start[follow], follow - 1
            far = np.flatnonzero(before != hub)
            i, j = np.concatenate([hub, before[far]]), np.concatenate([follow, follow[far]])
            ok = rows.similar(i, j, percent)
            a, b = rows.key[i[ok]], rows.key[j[ok]]
            if len(a):
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, none], ["a", "b", "place", "cells0", "cells1"])
            sizes = np.bincount(start, minlength=count)[start]
            hot = (rows.token.view(_U) >> _U(52)).astype(np.int64) > top  # other tasks have members as well
            shared = ((sizes >= 2) | hot) & (index >= (0 if skip < 2 else 2)) & ~(hot & (index < skip))  # a list of two rows held has been put out, and so has one of a hot list
            short = shared & ~hot & (sizes <= SHORT) & (start >= skip) & (start != start[-1])  # short lists that lie in this batch as a whole
            useful = ~short
            for d in range(1, SHORT):
                i = np.flatnonzero(short[:-d] & (start[d:] == start[:-d]))
                if not len(i):
                    break
                i = i[rows.similar(i, i + d, percent)]
                useful[i] = useful[i + d] = True
            shared &= useful
            put = np.flatnonzero(shared)
            if len(put):
                yield pa.RecordBatch.from_arrays([pa.array(rows.cols[c][put]) for c in ("token", "key", "place", "cells0", "cells1")], ["a", "b", "place", "cells0", "cells1"])
            held = rows.take(np.unique([start[-1], count - 1]))

    salted = posted.withColumn("salt", dealt(F.col("token"), F.col("key"), HOT)).repartition("token", "salt").sortWithinPartitions("token", "salt", "place", "cells0", "cells1", "key")
    return salted.drop("salt").mapInArrow(run, "a long, b long, place long, cells0 long, cells1 long")


def across(lists: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """a, b: pairs of members of different components (column comp) in a list that pass the filters, also on sketches; ``nearest``: for each member and other
    component only the one of the nearest sketch."""

    def pairs(rows: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = rows.take(np.argsort(rows.n, kind="stable"))
        comp, salt = rows.cols["comp"], rows.cols["salt"]
        alone = rows.cols["x"][0] == rows.cols["y"][0]  # else a cell of two parts of a list: pairs within a part are others' work
        values, inverse, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        small = np.flatnonzero(inverse != sizes.argmax())
        bits = np.frombuffer(b"".join(rows.cols["sketch"].tolist()), np.uint64).reshape(len(comp), -1)
        done = np.zeros(len(comp), bool)
        for i in small.tolist():
            lo = np.searchsorted(rows.n, -(-percent * rows.n[i] // 100), "left")
            hi = np.searchsorted(rows.n, 100 * rows.n[i] // percent, "right")
            j = lo + np.flatnonzero((comp[lo:hi] != comp[i]) & ~done[lo:hi] & ((salt[lo:hi] != salt[i]) | alone))
            done[i] = True
            if len(j):
                j = j[rows.similar(np.full(len(j), i), j, percent)]
            if len(j):
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                near = apart <= rows.n[i] + rows.n[j] - 2 * overlap(rows.n[i], rows.n[j], percent)
                j, apart = j[near], apart[near]
                if nearest and len(j) > 1:
                    j = j[np.argsort(apart, kind="stable")]
                    j = j[np.unique(comp[j], return_index=True)[1]]
                if len(j):
                    yield np.full(len(j), rows.key[i]), rows.key[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows | None = None
        for batch in _with_end(batches):
            rows = Rows(batch) if batch is not None else None
            if held is not None:
                rows = held + rows if rows is not None else held
            if rows is None:
                return
            x, y = rows.cols["x"], rows.cols["y"]
            cuts = np.flatnonzero((rows.token[1:] != rows.token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            edges = [0, *cuts.tolist(), len(rows.token)]
            whole = len(edges) - 1 if batch is None else len(edges) - 2
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(edges[:whole], edges[1 : whole + 1], strict=True):
                comp = rows.cols["comp"][a:b]
                if b - a > 1 and (comp != comp[0]).any():
                    for x, y in pairs(rows.take(slice(a, b))):
                        out.append((np.minimum(x, y), np.maximum(x, y)))
            held = rows.take(slice(edges[whole], None)) if batch is not None else None
            if out:
                found = np.unique(np.stack([np.concatenate([o[k] for o in out]) for k in (0, 1)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    # a list of more than CELL members is cut into parts, and each pair of parts meets in a cell
    parts = F.ceil(F.col("members") / CELL).cast("long")
    salted = lists.withColumn("salt", F.pmod(F.xxhash64("key"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    cells = salted.select("token", "key", "place", "cells0", "cells1", "comp", "sketch", "salt", F.least("salt", "other").alias("x"), F.greatest("salt", "other").alias("y"))
    return cells.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _bloom_at(ids: np.ndarray) -> list[np.ndarray]:
    """Three bit numbers for each id."""
    x = mixed(ids.astype(np.int64).view(_U) + _U(0x9E3779B97F4A7C15))
    return [(x >> _U(64 - BLOOM_BITS)).astype(np.int64), (x >> _U(20) & _U((1 << BLOOM_BITS) - 1)).astype(np.int64), (x & _U((1 << BLOOM_BITS) - 1)).astype(np.int64)]


def fetched_sets(docs: DataFrame, wanted: DataFrame, width: int, renamed: np.ndarray) -> DataFrame:
    """key, shingles (binary of ascending 64-bit hashes) of the rows ``wanted`` (rep, key; a written table), a key from each task at most, and some other keys.

    Up to ``FETCHED`` classes, documents that a filter of fixed size rules out aren't hashed; beyond, they are joined on their ids. Documents
    without ids, which no class that has others is named after, are hashed and told by their keys.
    """
    bits = KEY_BITS
    few = wanted.count() <= FETCHED
    table = None
    if few:

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bloom = np.zeros(1 << BLOOM_BITS, np.uint8)
            for b in batches:
                for at in _bloom_at(b.column("id").to_numpy()):
                    bloom[at] = 1
            rows = table_rows(np.packbits(bloom), "u1")
            for at in range(0, rows.num_rows, 256):
                yield rows.slice(at, 256)

        flat = np.zeros(1 << BLOOM_BITS >> 3, np.uint8).reshape(-1, SLICE)
        named = wanted.select(F.coalesce("rep", "key").alias("id"))
        for r in table_sum(named.mapInArrow(filled, "slice int, counts binary"), "u1", "u1", either=True).toLocalIterator():
            flat[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
        table = docs.sparkSession.sparkContext.broadcast(np.unpackbits(flat.reshape(-1)).astype(bool))

    def make():
        known = set()

        def part(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            if few:
                has, ids = table.value, batch.column("doc_id")
                ok = np.logical_and.reduce([has[at] for at in _bloom_at(ids.fill_null(0).to_numpy())]) | ids.is_null().to_numpy(zero_copy_only=False)
                if not ok.any():
                    return None
                batch = batch.filter(pa.array(ok))
            h, bounds = unique_sets(*buffer_of(batch.column("text")), width)
            names = class_keys(h, bounds, bits, renamed)[0]
            use = names != 0
            if few:  # a document without an id counts if its class is wanted by its key
                use &= np.logical_and.reduce([has[at] for at in _bloom_at(names)]) | batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            keys, edges = names.tolist(), bounds.tolist()
            rows = [i for i in np.flatnonzero(use).tolist() if keys[i] not in known and not (len(known) < 100_000 and known.add(keys[i]))]
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in rows], pa.int64()), pa.array([h[edges[i] : edges[i + 1]].tobytes() for i in rows], pa.binary())], ["key", "shingles"])

        return part

    docs = docs.select("doc_id", "text")
    if not few:
        reps = wanted.where("rep is not null").select("rep")
        docs = docs.join(reps, docs["doc_id"] == reps["rep"], "left_semi").unionAll(docs.where("doc_id is null"))
    return arrow_map(docs, make, "key long, shingles binary", "text")


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule similarity out."""

    def make():
        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), _U).reshape(batch.num_rows, -1) for c in ("x", "y"))
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= n + m - 2 * overlap(n, m, percent)
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

        return part

    with_x = pairs.join(classes.select(F.col("key").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("n")), "a")
    both = with_x.join(classes.select(F.col("key").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("m")), "b")
    return arrow_map(both.select("a", "b", "x", "y", "n", "m"), make, "a long, b long", "x")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def make():
        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                n, m = len(x) // 8, len(y) // 8
                both = np.concatenate([np.frombuffer(x, _U), np.frombuffer(y, _U)])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (n + m - same))
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return part

    with_x = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_x.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return arrow_map(both.select("a", "b", "x", "y"), make, "a long, b long", "x")


def contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars: (node, root) with the smallest node of what hangs together in the task as root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (y := up.get(top, top)) != top:
                top = y
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = [*up]
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in part], pa.int64()), pa.array(part, pa.int64())], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long").where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it hangs together with) for the nodes of undirected edges (a, b).

    Tasks contract their own edges, then large and small stars alternate until nothing changes; every state is a written table.
    """
    edges = written(contracted(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "edges")
    mark = None
    while True:
        # large star: every larger neighbour of u hangs on u's smallest neighbour
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours hang on the smallest of these
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("a").alias("y")), F.struct(F.col("m").alias("x"), F.col("b").alias("y")))).alias("e"))
        new = written(contracted(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct()), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("b")).first()
        forget(edges)
        edges = new
        if now == mark and now[0] == now[2] or not now[0]:
            out = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            out._millrace_path = edges._millrace_path
            return out
        mark = now


def ngram_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of documents (doc_id, mark, text): rows (doc_id, mark, n_shingles, key), and (key, rep, root) of each class of equal sets: its smallest id, and its component."""
    spark = docs.sparkSession
    base = written(classes_and_counts(docs, width), "ngram-classes")
    counts = np.zeros((2 << BUCKET_BITS) // SLICE * SLICE, np.int64).reshape(-1, SLICE)
    for r in table_sum(base.where("slice is not null"), "<u4").toLocalIterator():
        counts[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    rows = base.where("slice is null").select("doc_id", "mark", "n_shingles", "key", "other", "sketch")

    def classes_of(rows: DataFrame) -> DataFrame:
        grouped = rows.where("n_shingles > 0").groupBy("key")
        least = [F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in ("n_shingles", "sketch"))]
        return written(grouped.agg(*least, F.min("other").alias("lo"), F.max("other").alias("hi")), "ngram-keys")

    classes = classes_of(rows)
    # names of several classes: none is to be expected below 2 ** 32 classes, a handful at 2 ** 34
    renamed = np.array([r["key"] for r in classes.where("lo <> hi").select("key").collect()], np.int64)
    if len(renamed):
        names = spark.createDataFrame([(int(k),) for k in renamed], "renamed long")
        rows = rows.join(F.broadcast(names), rows["key"] == names["renamed"], "left").withColumn("key", F.when(F.col("renamed").isNull(), F.col("key")).otherwise(F.col("other")))
        forget(classes)
        classes = classes_of(rows)
    lists = written(first_round(postings(docs, width, percent, counts.reshape(2, -1), renamed), percent), "ngram-lists")
    rows = rows.select("doc_id", "mark", "n_shingles", "key")

    passing = [lists]  # tables that nothing reads in the end

    def kept(df: DataFrame, label: str) -> DataFrame:
        passing.append(written(df, label))
        return passing[-1]

    def linked(pairs: DataFrame) -> DataFrame:
        keys = pairs.select("a").union(pairs.select("b")).distinct().toDF("key")
        wanted = written(classes.join(keys, "key").select("rep", "key"), "ngram-wanted")
        sets = written(fetched_sets(docs, wanted, width, renamed), "ngram-sets")
        out = kept(verified(pairs, sets, percent).distinct(), "ngram-links")
        forget(sets)
        forget(wanted)
        return out

    def apart(held: DataFrame, roots: DataFrame) -> DataFrame:
        """The postings of lists of several components, with the component of each."""
        columns = ("key", "place", "cells0", "cells1")
        named = held.join(roots, held["key"] == roots["node"], "left").select("token", *columns, F.coalesce("root", "key").alias("comp"))
        # sums of a task's own postings go before the shuffle, so that no list meets in a task
        several = named.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("members")).where("x <> y").select("token", "members")
        parts = several.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts_of(F.col("token"), MEET) - 1)))
        parts = kept(parts, "ngram-mixed")  # Spark broadcasts it if it is small by its own bound
        return kept(named.withColumn("salt", dealt(F.col("token"), F.col("key"), MEET)).join(parts, ["token", "salt"]).drop("salt"), "ngram-apart")

    tried = kept(lists.where("place is null").select("a", "b").distinct(), "ngram-pairs")
    links = linked(kept(alike(tried, classes, percent), "ngram-near"))
    roots = components(links)
    held = lists.where("place is not null").select(F.col("a").alias("token"), F.col("b").alias("key"), "place", "cells0", "cells1")
    for nearest in (True, False):
        held = apart(held.select("token", "key", "place", "cells0", "cells1"), roots)
        rest = across(held.join(classes.select("key", "sketch"), "key"), percent, nearest)
        rest = kept(rest.distinct().join(tried, ["a", "b"], "left_anti"), "ngram-pairs")
        if rest.isEmpty():
            continue
        more = linked(rest)
        tried = tried.union(rest)
        if not more.isEmpty():
            links = links.union(more)
            forget(roots)
            roots = components(links)
    named = written(classes.join(roots, classes["key"] == roots["node"], "left").select("key", "rep", F.coalesce("root", "key").alias("root")), "ngram-roots")
    for table in (*passing, classes, roots):
        forget(table)
    return rows, named


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row.

    Sets hold distinct ``width``-word shingles, or the whole sequence of fewer words; two link when 100 * intersection >= percent * union. A row without
    words (or with null text) is linked with nothing. Rows that repeat an id stay, each with its own set's component; a null id never names
    a component unless all ids of it are null. Whole numbers as ids. An empty table gives no rows; other columns don't matter.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.lit(None).cast("string").alias("mark"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    rows, named = ngram_classes(docs, width, percent)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = named.join(least, "root").select("key", "component_id")
    out = rows.join(final, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``df`` for each group of near copies, with all columns, and every row without words.

    The row that stays is the first by id (null ids last), then by a digest of its text. Rows are told by id and text: where an id repeats, a row with
    another text that has no copy stays, and of rows of equal id and text one stays. An empty table gives no rows.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("mark"), text.alias("text"))
    rows, named = ngram_classes(docs, width, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    worded = rows.where("n_shingles > 0").withColumn("at", order)
    first = worded.groupBy("key").agg(F.min("at").alias("at")).join(named, "key").groupBy("root").agg(F.min("at").alias("first"))
    decided = worded.join(named.join(first, "root").select("key", "first"), "key")
    # sizes are known before the joins are planned
    columns = {c: unused(df, c) for c in ("gone_id", "gone_mark")}
    key = [F.col("doc_id").alias(columns["gone_id"]), F.col("mark").alias(columns["gone_mark"])]
    stays = F.col("at").eqNullSafe(F.col("first"))
    gone = written(decided.where(~stays).select(*key).distinct(), "gone")
    again = written(decided.where(stays).groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select(*key), "again")

    def among(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        same = rows[id_col].cast("long").eqNullSafe(table[columns["gone_id"]]) & (F.md5(F.coalesce(rows[text_col].cast("string"), F.lit("")).cast("binary")) == table[columns["gone_mark"]])
        return rows.join(table, same, how)

    kept = among(df, gone, "left_anti")
    if again.isEmpty():
        return kept
    # of equal rows one: sums of a task's own rows go before the shuffle
    twice = among(kept, again, "left_semi")
    name = unused(df, "row")
    ranked = twice.groupBy(twice[id_col].cast("long").alias(columns["gone_id"]), F.md5(F.coalesce(twice[text_col].cast("string"), F.lit("")).cast("binary")).alias(columns["gone_mark"]))
    pick_one = F.min if all("map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString() for f in df.schema) else F.first
    once = ranked.agg(pick_one(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(name))
    return among(kept, again, "left_anti").unionAll(once.select(*(F.col(name)[c].alias(c) for c in df.columns)))
