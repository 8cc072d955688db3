"""How the words of a language's sources diverge: for each source its distance to the others, and the terms that stand out in it.

Two passes. The first one counts in how many documents of its language each term is; terms in ``least`` documents or more are kept. The second one counts the kept
terms' occurrences by source with Aho-Corasick automata over the terms with a delimiter on either side. The automaton that every task has holds the terms in
the most documents, ``head`` of them at the most; what it leaves of the texts (kept terms beyond the head, and other words that a bitmap of a fixed size doesn't tell from these) is counted up
in its task and dealt out by term, and each task there has an automaton of its own share of the other kept terms. So the vocabulary may have any size, and a frequent term is never shuffled by
occurrence.

Postings (source, term, occurrences) are sparse. A pair's sum over all kept terms is that of a pair without any words, corrected by each source's histogram of shares, and
by the terms that both sources have, which are added up in arrays of the tasks that hold the terms' postings.

Null texts, languages and sources count as empty; rows that repeat count again; ties are broken by the item's bytes; an empty table gives no row; other columns don't matter,
whatever they are called. Sums are whole numbers of 64 bits: exact up to a billion kept terms in a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import SLICE, buffer_of, chunks, in_few_tasks, release, span_hashes, table_rows, table_sum, written

#: Terms of the automaton that every task has, and the most bytes of one of them.
HEAD, HEAD_BYTES = 200_000, 64
#: Terms of other automata, about; bits of the bitmap of their terms.
BLOCK, BITS = 100_000, 1 << 26
#: Entries that a task counts up before it gives them out; terms of the head whose counts travel in one row; tasks whose rows are summed together first.
ENTRIES, SLICE_TERMS, TOGETHER = 400_000, 4096, 64
#: Pairs of sources that a task takes up at once, and those that it keeps sums of.
PAIRS, CELLS = 1 << 20, 1 << 21
UNIT = 1_000_000_000

#: A-Z become a-z, bytes that are in no term become spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_POSTING = "lang string, source string, term string, n long"


def _documents(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return df.select(*(F.coalesce(df[c].cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def _groups_of(batch: pa.RecordBatch) -> Iterator[tuple[str, str, bytes]]:
    """The texts of a slice by language and source: terms with spaces around them."""
    by: dict[tuple[str, str], list[bytes]] = {}
    for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
        by.setdefault((lang, source), []).append(text.as_buffer().to_pybytes().translate(_TERMS))
    for (lang, source), texts in by.items():
        yield lang, source, b" %b " % b" ".join(texts)


def _rows(counts: dict[tuple, int], names: list[str]) -> pa.RecordBatch:
    keys = list(zip(*counts, strict=True))
    arrays = [pa.array(k, pa.string()) if not isinstance(k[0], bytes) else pa.array(k, pa.binary()).cast(pa.string()) for k in keys]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(list(counts.values()), pa.int64())], [*names, "n"])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """Rows (lang, term, n): the documents of a language that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, terms in counts.items():
                if terms:
                    yield _rows({(lang, t): n for t, n in terms.items()}, ["lang", "term"])
            counts.clear()

        for batch in batches:
            for part in chunks(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text"), strict=True):
                    counts.setdefault(lang, Counter()).update(set(text.as_buffer().to_pybytes().translate(_TERMS).split()))
                if sum(map(len, counts.values())) > ENTRIES:
                    yield from out()
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _steps(n: Column) -> Column:
    """Sizes on a scale of eighths of a doubling."""
    return F.floor(F.log2(n) * 8)


def _head(kept: DataFrame, head: int) -> tuple[dict[str, list[bytes]], Column, int]:
    """Terms in the most documents, ``head`` at the most, by language; the condition that tells them; how many kept terms there are besides."""
    short = F.octet_length("term") <= HEAD_BYTES
    step = _steps(F.col("n"))
    sizes = kept.groupBy(step.alias("step"), short.alias("short")).agg(F.count("*").alias("k")).collect()  # a few hundred rows
    total, got, least = sum(r["k"] for r in sizes), 0, None
    for r in sorted((r for r in sizes if r["short"]), key=lambda r: -r["step"]):
        if got + r["k"] > head:
            break
        got, least = got + r["k"], r["step"]
    if least is None:
        return {}, F.lit(False), total
    among = short & (step >= least)
    terms: dict[str, list[bytes]] = {}
    table = kept.where(among).select("lang", "term").toArrow()
    for lang, term in zip(table["lang"].to_pylist(), table["term"].cast(pa.binary()).to_pylist(), strict=True):
        terms.setdefault(lang, []).append(term)
    return terms, among, total - got


def automaton(terms: list[bytes]):
    """An automaton over bytes that finds the terms with a delimiter on either side; its values are their places in the list. Without terms none."""
    import ahocorasick

    if not terms:
        return None
    out = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        out.add_word(f" {term.decode('latin-1')} ", i)
    out.make_automaton()
    return out


def matches(finder, padded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the delimiters after found terms are, and which terms these are."""
    if finder is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.fromiter(chain.from_iterable(finder.iter(padded.decode("latin-1"))), np.int64)
    return flat[::2], flat[1::2]


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte of the bitmap and the bit in it."""
    at = hashes % np.uint64(BITS)
    return (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))


def bitmap(terms: DataFrame) -> np.ndarray:
    """``BITS`` bits in which those of the terms' hashes are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            raw, offsets = buffer_of(batch.column("term"))
            if len(raw):
                np.bitwise_or.at(bits, *_places(span_hashes(raw)(offsets[:-1], offsets[1:])))
        if bits.any():
            yield table_rows(bits, "u1")

    out = np.zeros(BITS // 8, np.uint8)
    for r in table_sum(in_few_tasks(terms.select("term")).mapInArrow(run, "slice int, counts binary"), "u1", "u1", either=True).collect():  # a table of a fixed size
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.uint8)
    return out


def others(padded: bytes, ends: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """The words of a padded text that end at none of ``ends`` and may be in the bitmap."""
    raw = np.frombuffer(padded, np.uint8)
    space = raw == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stops = np.flatnonzero(~space[:-1] & space[1:]) + 1
    found = np.zeros(len(padded), bool)
    found[ends] = True
    left = ~found[stops]
    starts, stops = starts[left], stops[left]
    if not len(starts):
        return []
    byte, bit = _places(span_hashes(raw)(starts, stops))
    there = (bits[byte] & bit) != 0
    return [padded[a:b] for a, b in zip(starts[there].tolist(), stops[there].tolist(), strict=True)]


def occurrences(docs: DataFrame, kept: DataFrame, head: int = HEAD, block: int = BLOCK) -> DataFrame:
    """Rows (lang, source, term, n): the occurrences of kept terms, those of ``kept`` (lang, term, n)."""
    spark = docs.sparkSession
    terms, among, rest = _head(kept, head)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rest // block))
    buckets = 8 * n
    shared = spark.sparkContext.broadcast((terms, bitmap(kept.where(~among)) if rest else None))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known, bits = shared.value
        names = ["lang", "source", "slice", "packed", "bucket", "words"]
        finders = {lang: automaton(t) for lang, t in known.items()}
        counts: dict[tuple[str, str], np.ndarray] = {}
        left: dict[tuple[str, str], Counter] = {}

        def out_left() -> Iterator[pa.RecordBatch]:
            for (lang, source), words in left.items():
                by: dict[int, list[bytes]] = {}
                for w in words:
                    by.setdefault(crc32(w) % buckets, []).append(w)
                m = len(by)
                joined = pa.array([b" ".join(some) for some in by.values()], pa.binary()).cast(pa.string())
                packed = pa.array([np.fromiter((words[w] for w in some), np.int64, len(some)).tobytes() for some in by.values()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([source] * m), pa.nulls(m, pa.int32()), packed, pa.array(list(by), pa.int32()), joined], names)
            left.clear()

        def out_counts() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in counts.items():
                at = np.flatnonzero(n)
                edges = np.searchsorted(at, np.arange(0, len(n) + SLICE_TERMS, SLICE_TERMS)).tolist()
                slices = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
                m = len(slices)
                if m:
                    packed = [np.stack([at[a:b], n[at[a:b]]]).tobytes() for _, a, b in slices]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([source] * m), pa.array([k for k, _, _ in slices], pa.int32()), pa.array(packed, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.string())], names)
            counts.clear()

        for batch in batches:
            for part in chunks(batch, "text"):
                for lang, source, padded in _groups_of(part):
                    ends, which = matches(finders.get(lang), padded)
                    if len(which):
                        if (lang, source) not in counts:
                            counts[lang, source] = np.zeros(len(known[lang]), np.int64)
                        counts[lang, source] += np.bincount(which, minlength=len(known[lang]))
                        if sum(map(len, counts.values())) > 20 * ENTRIES:
                            yield from out_counts()
                    words = others(padded, ends, bits) if rest else None
                    if words:
                        left.setdefault((lang, source), Counter()).update(words)
                if sum(map(len, left.values())) > ENTRIES:
                    yield from out_left()
        yield from out_left()
        yield from out_counts()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by language and slice of the head's terms: the counts of each source there."""
        known = shared.value[0]
        here, got = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            for source, n in got.items():
                at = np.flatnonzero(n)
                lang, base = here[0], here[1] * SLICE_TERMS
                terms = pa.array([known[lang][base + i] for i in at.tolist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array([source] * len(at)), terms, pa.array(n[at])], ["lang", "source", "term", "n"])
            got.clear()

        for batch in batches:
            for lang, source, k, packed in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "slice", "packed")), strict=True):
                if (lang, k) != here or len(got) * SLICE_TERMS > 20 * ENTRIES and source not in got:
                    yield from out()
                here = lang, k
                at, n = np.frombuffer(packed, np.int64).reshape(2, -1)
                if source not in got:
                    got[source] = np.zeros(SLICE_TERMS, np.int64)
                got[source][at - k * SLICE_TERMS] += n
        if here is not None:
            yield from out()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by language; of each, its kept terms come before the words to count."""
        lang, terms, finder = None, [], None
        for batch in batches:
            for at, here, known in _runs(batch):
                part = batch.slice(*at)
                if here != lang:
                    lang, terms, finder = here, [], None
                words = part.column("words").cast(pa.binary()).to_pylist()
                if known:
                    terms += words
                    continue
                if terms and finder is None:
                    finder = automaton(terms)
                counts: dict[tuple, int] = {}
                for source, row, packed in zip(part.column("source").to_pylist(), words, part.column("packed").to_pylist(), strict=True):
                    ends, _ = matches(finder, b" %b " % row)
                    row, n = row.split(b" "), np.frombuffer(packed, np.int64)
                    stops = np.cumsum(np.fromiter((len(w) + 1 for w in row), np.int64, len(row)))
                    for i in np.searchsorted(stops, ends).tolist():
                        counts[lang, source, row[i]] = counts.get((lang, source, row[i]), 0) + int(n[i])
                if counts:
                    yield _rows(counts, ["lang", "source", "term"])

    # the first pass over the texts runs once: what it found, packed by slices of the head, and what it left stand in one table
    table = written(docs.mapInArrow(first, "lang string, source string, slice int, packed binary, bucket int, words string").withColumn("part", (F.spark_partition_id() / TOGETHER).cast("int")), "audit-first")
    packed = table.where("slice is not null").select("lang", "source", "slice", "packed", "part").repartition("lang", "slice", "part").sortWithinPartitions("lang", "slice")
    found = packed.mapInArrow(summed, _POSTING)
    if rest:
        left = table.where("bucket is not null").select("lang", "source", "packed", "bucket", "words", F.lit(False).alias("known"))
        place = (F.crc32(F.encode("term", "UTF-8")) % buckets).cast("int")
        names = kept.where(~among).select("lang", F.lit("").alias("source"), F.lit(None).cast("binary").alias("packed"), place.alias("bucket"), F.col("term").alias("words"), F.lit(True).alias("known"))
        dealt = names.unionByName(left).repartition(n, "bucket").sortWithinPartitions("lang", F.desc("known"))
        found = found.unionByName(dealt.mapInArrow(second, _POSTING))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], str, bool]]:
    """Stretches of a sorted batch of one language and kind."""
    if not batch.num_rows:
        return
    langs, known = batch.column("lang").dictionary_encode(), np.asarray(batch.column("known"))
    codes = np.asarray(langs.indices) * 2 + known
    edges = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]]).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield (a, b - a), langs.dictionary[int(codes[a]) // 2].as_py(), bool(known[a])


def share(n: Column, total: Column, terms: Column) -> Column:
    """A term's share of a group's occurrences in billionths, one added to every count; 0 where there are no terms."""
    div = lambda a, b: F.call_function("div", a, b)
    # decimals only where 64 bits don't hold the product
    wide = div(F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))
    return F.when(terms > 0, 1 + F.when(n < UNIT, div(F.lit(UNIT).cast("long") * (n.cast("long") + 1), total + terms)).otherwise(wide)).otherwise(0).cast("long")


def excess(p: Column, q: Column) -> Column:
    return F.when(q > 0, F.call_function("div", (p - q) * (p - q), q)).otherwise(0).cast("long")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def both_sums(postings: DataFrame) -> DataFrame:
    """Rows (lang, a, b, v) whose sums over v are, for sources a and b, those of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) over the terms that both have.

    ``postings``: lang, term, at (the source's number in its language), p and p0 (the shares with and without occurrences).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, keys: np.ndarray, values: np.ndarray) -> None:
            if lang in sums:
                keys, values = np.concatenate([sums[lang][0], keys]), np.concatenate([sums[lang][1], values])
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sums[lang] = keys[first], np.add.reduceat(values, first)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (keys, values) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(values)], ["lang", "a", "b", "v"])
            sums.clear()

        def taken(t: pa.Table) -> None:
            """Whole terms."""
            lang_codes = t["lang"].combine_chunks().dictionary_encode()
            codes = np.asarray(lang_codes.indices)
            terms = np.asarray(t["term"].combine_chunks().dictionary_encode().indices)
            at, p, p0 = (np.asarray(t[c]) for c in ("at", "p", "p0"))
            first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (codes[1:] != codes[:-1])]))
            size = np.diff(np.concatenate([first, [len(at)]]))
            for k in np.unique(size).tolist():
                if k < 2:
                    continue
                for code in np.unique(codes[first[size == k]]).tolist():
                    starts = first[(size == k) & (codes[first] == code)]
                    width = max(1, min(k, PAIRS // k))
                    step = max(1, PAIRS // (k * width))
                    for i in range(0, len(starts), step):
                        rows = starts[i : i + step, None] + np.arange(k)
                        b, q, q0 = at[rows][:, None, :], p[rows][:, None, :], p0[rows][:, None, :]
                        for j in range(0, k, width):
                            a, x, x0 = at[rows][:, j : j + width, None], p[rows][:, j : j + width, None], p0[rows][:, j : j + width, None]
                            v = _f(x, q) - _f(x, q0) - _f(x0, q) + _f(x0, q0)
                            keys = (a << 32) | b
                            add(lang_codes.dictionary[code].as_py(), keys.ravel(), v.ravel())

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 16:
                continue
            t = pa.Table.from_batches(held)
            # the last term may go on in the next batch
            same = pc.and_(pc.equal(t["term"], t["term"][-1]), pc.equal(t["lang"], t["lang"][-1])).to_numpy()
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                taken(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                if sum(len(k) for k, _ in sums.values()) > CELLS:
                    yield from out()
        if held:
            taken(pa.Table.from_batches(held))
        yield from out()

    dealt = postings.select("lang", "term", "at", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "lang string, a long, b long, v long")


def audit_sources(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, ranks: int = 200, head: int = HEAD, block: int = BLOCK) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each language and source of the documents.

    Part pair: item is another source of the language, value how far it is away, all ranks. Part term: item is a term whose share is higher in the source than in its language,
    value how far, the first ``ranks``. A share is ``1 + 10**9 * (n + 1) // (N + V)``: n the term's occurrences, N those of the language's V kept terms; the distance of shares is
    ``(p - q)**2 // q``. Ranks go by value from the highest, then by item.
    """
    docs = _documents(df, text_col, lang_col, source_col)
    kept = written(document_frequencies(docs).where(F.col("n") >= least), "audit-kept")
    postings = written(occurrences(docs, kept, head, block), "audit-postings")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("_docs")).drop("_docs").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "terms"])
    # a row for each source of a language: as many as the sources, whatever the documents
    groups = groups.withColumn("at", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")).withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms")))
    groups = written(groups, "audit-groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))

    shares = postings.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_lang = F.sum("n").over(Window.partitionBy("lang", "term"))
    terms = shares.withColumn("all_n", of_lang).join(langs, "lang").withColumn("q", share(F.col("all_n"), F.col("all_total"), F.col("terms"))).where(F.col("p") > F.col("q"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)

    one = groups.select("lang", F.col("source").alias("source"), F.col("at").alias("a"), F.col("p0").alias("x0"), "terms")
    two = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"), F.col("p0").alias("y0"))
    histogram = shares.groupBy("lang", "at", "p0", "p").agg(F.count("*").alias("k"))
    other = groups.select("lang", F.col("at").alias("o"), F.col("p0").alias("o0"))
    p, p0, o0 = F.col("p"), F.col("p0"), F.col("o0")
    each = histogram.join(other, "lang").where(F.col("o") != F.col("at"))
    ways = F.array(
        F.struct(F.col("at").alias("a"), F.col("o").alias("b"), (F.col("k") * (excess(p, o0) - excess(p0, o0))).alias("v")),
        F.struct(F.col("o").alias("a"), F.col("at").alias("b"), (F.col("k") * (excess(o0, p) - excess(o0, p0))).alias("v")),
    )
    sides = each.select("lang", F.explode(ways).alias("w")).select("lang", "w.a", "w.b", "w.v")
    moved = sides.unionByName(both_sums(shares)).groupBy("lang", "a", "b").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
    pairs = one.join(two, "lang").where(F.col("a") != F.col("b")).join(moved, ["lang", "a", "b"], "left")
    value = F.col("terms").cast("decimal(20,0)") * excess(F.col("x0"), F.col("y0")).cast("decimal(18,0)") + F.coalesce("v", F.lit(0).cast("decimal(30,0)"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
