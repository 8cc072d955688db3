"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms over all documents (a table of fixed size).
2. A distributed randomised SVD of all documents' TF-IDF passages A: each task adds its part of Y = A'(A Omega) for a seeded random Omega; from the
   sum, A'A is about Y (Omega'Y)^-1 Y' (Nystroem), whose eigenvectors and singular values the driver takes from a matrix of fixed size.
3. Passages of three quarters of an item's words are folded in; where one reaches the cosine ``COSINE`` with the item, the words around it are
   checked against the item's: longest common subsequence in a stretch of about the item's length, and how much of the item's answer is in it.
   Cosines are taken where the check can succeed at all, which an index of the items' rare words tells: the rows are the same as if every
   passage were compared with every item, but the work grows with the rare words' occurrences, not with passages times items.
4. A stretch that is the item word for word (its cosine is 1) is found by the item's rarest word as well, whatever the passages around it.

A benchmark item's answer is its last sentence (of two or more); an item of one sentence has none, and its whole text counts as it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import PUNCTUATION, SLICE, arrow_map, chunks, id_type, in_few_tasks, lowered, mixed, pick, release, table_rows, table_sum, unused, word_hashes, written

#: Bits of hashed terms, dimensions kept and drawn, words of an SVD passage; terms in a slice of the product, and the unit of its whole-number sums.
TERM_BITS = 15
KEPT = 96
DRAWN = 104
PASSAGE = 48
SEED = 7
TERMS = 64
UNIT = 2.0**-20
#: Items of fewer words are sought word for word only. Items, and bytes of their texts, that are sought in one pass over the documents; more are sought in parts.
SHORTEST = 8
MOST_ITEMS = 50_000
MOST_BYTES = 64 << 20
#: The share of an item's words, the rarest first, that the index has: a stretch with a common subsequence of PARAPHRASE has at least
#: (RARE - 1 + PARAPHRASE) of the item's words from among them.
RARE = 0.65
#: A passage's share of the item's words, and how many passages begin within an item's length; words that are folded in at once.
SHARE = 0.75
STARTS = 8
FOLDED = 1 << 15
#: A candidate's least cosine; the common subsequence's least share of the item, alone or along with the share of the answer that must be there.
COSINE = 0.3
VERBATIM = 0.7
PARAPHRASE = 0.6
ANSWER = 0.8

_U = np.uint64


def terms(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - TERM_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many documents each hashed term is; the last entry is the number of documents with words. Null or empty texts have none; repeated rows count each; an empty table gives zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros((1 << TERM_BITS) + SLICE, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                h, _, _, first = word_hashes(*lowered(part.column("text")), PUNCTUATION)
                t, edges = terms(h), first.tolist()
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    t[a:b].sort()
                new = np.ones(len(t), bool)
                new[1:] = t[1:] != t[:-1]
                new[first[:-1][first[:-1] < len(t)]] = True
                counts += np.bincount(t[new], minlength=len(counts))
                counts[-1] += int((np.diff(first) > 0).sum())
        rows = table_rows(counts, "<i8")
        for at in range(0, rows.num_rows, 64):
            yield rows.slice(at, 64)

    out = np.zeros(((1 << TERM_BITS) // SLICE + 1, SLICE), np.int64)
    for r in table_sum(in_few_tasks(docs.select("text")).mapInArrow(run, "slice int, counts binary"), "<i8").toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    flat = out.reshape(-1)
    return np.append(flat[: 1 << TERM_BITS], flat[-1])


def weights(frequencies: np.ndarray) -> np.ndarray:
    """Inverse document frequencies."""
    return np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])).astype(np.float32) + np.float32(0.1)


def gaussian() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((1 << TERM_BITS, DRAWN), np.float32)


def passages_of(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Terms in rows of ``PASSAGE``, each text's filled up to whole rows with the term after the last."""
    n = np.diff(first)
    bounds = np.concatenate([[0], np.cumsum(-(-n // PASSAGE))])
    out = np.full(int(bounds[-1]) * PASSAGE, 1 << TERM_BITS, np.int64)
    out[np.repeat(bounds[:-1] * PASSAGE - first[:-1], n) + np.arange(len(t))] = t
    return out.reshape(-1, PASSAGE)


def scatter(y: np.ndarray, t: np.ndarray, z: np.ndarray) -> None:
    """Adds to the row of y of each term of each passage the passage's row of z. Terms with as many places are added up together."""
    order = np.argsort(t, kind="stable")
    rows, s = (order // PASSAGE).astype(np.int32), t[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n = np.diff(np.append(begin, len(s)))
    sums = np.empty((len(begin), z.shape[1]), np.float32)
    few = n < 64
    for size in np.unique(n[few]).tolist():
        of = np.flatnonzero(n == size)
        places = (begin[of][:, None] + np.arange(size)).reshape(-1)
        sums[of] = np.einsum("ijk->ik", z.take(rows[places], axis=0, mode="clip").reshape(-1, size, z.shape[1]))
    for k in np.flatnonzero(~few).tolist():
        sums[k] = z.take(rows[begin[k] : begin[k] + n[k]], axis=0, mode="clip").sum(axis=0)
    y[s[begin]] += sums


def passage_products(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Y = A'(A Omega) over all passages of all documents: terms x ``DRAWN``, summed on the executors in slices, as whole numbers of ``UNIT``, so that the order doesn't matter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        omega = np.vstack([gaussian() * idf[:, None], np.zeros((1, DRAWN), np.float32)])
        square = np.append(idf, np.float32(0)) ** 2
        y = np.zeros(((1 << TERM_BITS) + 1, DRAWN), np.float32)
        for batch in batches:
            for part in chunks(batch, "text"):
                h, _, _, first = word_hashes(*lowered(part.column("text")), PUNCTUATION)
                t = passages_of(terms(h), first)
                if not len(t):
                    continue
                norm = square[t].sum(axis=1)  # a term's repeats count each by itself
                z = np.empty((len(t), DRAWN), np.float32)
                for a in range(0, len(t), 1024):
                    z[a : a + 1024] = np.einsum("ijk->ik", omega.take(t[a : a + 1024].reshape(-1), axis=0, mode="clip").reshape(-1, PASSAGE, DRAWN))
                z /= norm[:, None]
                scatter(y, t.reshape(-1).astype(np.uint16), z)
        y = y[:-1] * idf[:, None]
        for k in range(0, len(y) // TERMS, 16):
            some = [i for i in range(k, k + 16) if y[i * TERMS : (i + 1) * TERMS].any()]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([y[i * TERMS : (i + 1) * TERMS].tobytes() for i in some], pa.binary())], ["slice", "counts"])

    y = np.zeros(((1 << TERM_BITS) // TERMS, TERMS, DRAWN))
    for r in table_sum(in_few_tasks(docs.select("text")).mapInArrow(run, "slice int, counts binary"), "<f4", unit=UNIT).toLocalIterator():
        y[r["slice"]] = np.frombuffer(r["counts"], np.int64).reshape(TERMS, DRAWN) * UNIT
    return y.reshape(-1, DRAWN)


def latent_terms(y: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each term's vector in the latent space (one more row of zeros): idf * right singular vectors / singular values."""
    omega = gaussian().astype(np.float64)
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(initial=0), 1e-30)
    if not good.any():
        return np.zeros((len(y) + 1, 1), np.float32)
    b = y @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    keep = min(KEPT, int((s > 1e-6 * s[0]).sum()))
    return np.vstack([u[:, :keep] / s[:keep] * idf[:, None], np.zeros((1, keep))]).astype(np.float32)


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    answer: np.ndarray


def items_of(rows: list[tuple]) -> list[Item]:
    """Items with words, from rows (item_id, text)."""
    out = []
    for item_id, text in rows:
        sentences = [s for s in re.split(r"(?<=[.?!])\s+", text or "") if s.strip()]
        words = _words(text or "")
        if not len(words):
            continue
        answer = _words(sentences[-1]) if len(sentences) > 1 else words
        out.append(Item(item_id, words, np.unique(answer if len(answer) else words)))
    return out


def masks_of(words: list[int]) -> dict[int, int]:
    """For each word, a bit for each place of it."""
    masks: dict[int, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _words(text: str) -> np.ndarray:
    return word_hashes(*lowered(pa.array([text])), PUNCTUATION)[0]


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence with an item of ``n`` words, a bit for each of them."""
    full = (1 << n) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        if u:
            v = (v + u | v - u) & full
    return n - v.bit_count()


def leaks(share: float, answer: float) -> bool:
    return share >= VERBATIM or share >= PARAPHRASE and answer >= ANSWER


def best_stretch(masks: dict[int, int], in_answer: set[int], n: int, words: list[int]) -> tuple[float, float]:
    """Over stretches of a quarter more than the item's ``n`` words that begin on a word of the item, of those that hold the item if any does: the
    largest share of the item in common, and the share of its answer's words in that stretch."""
    at = [i for i, w in enumerate(words) if w in masks]
    length, best, k = n + n // 4, (False, 0, 0.0), 0
    least = int(np.ceil(PARAPHRASE * n))
    most = n  # what the stretch can have in common: what the last one had, and the words that have come in since
    counts: dict[int, int] = {}  # the answer's words in the stretch
    for i, p in enumerate(at):
        if i and (w := words[at[i - 1]]) in in_answer:
            counts[w] -= 1
            if not counts[w]:
                del counts[w]
        while k < len(at) and at[k] < p + length:
            if (w := words[at[k]]) in in_answer:
                counts[w] = counts.get(w, 0) + 1
            k, most = k + 1, most + 1
        bound, answer = min(most, k - i, n), len(counts) / len(in_answer)
        if bound < least or (leaks(bound / n, answer), bound, answer) <= best:
            continue
        most = got = common_subsequence(masks, n, [words[j] for j in at[i:k]])
        best = max(best, (leaks(got / n, answer), got, answer))
    return best[1] / n, best[2]


def best_cosine(vectors: np.ndarray, t: np.ndarray, item: np.ndarray, n: int) -> float:
    """The largest cosine of the item's vector with a passage of ``SHARE`` of its ``n`` words in the terms ``t``."""
    size, step = max(1, int(np.ceil(SHARE * n))), max(1, n // STARTS)
    if len(t) <= size:
        v = vectors[t].sum(axis=0)
        return float(v @ item / (np.linalg.norm(v) + 1e-12))
    best = -1.0
    starts = np.append(np.arange(0, len(t) - size, step), len(t) - size)
    per = max(1, FOLDED // step)
    for a in range(0, len(starts), per):
        some = starts[a : a + per]
        words = vectors[t[some[0] : some[-1] + size]]
        sums = np.cumsum(words, axis=0, dtype=np.float64)
        at = some - some[0]
        v = sums[at + size - 1] - sums[at] + words[at]
        best = max(best, float((v @ item / (np.sqrt(np.einsum("ij,ij->i", v, v)) + 1e-12)).max()))
    return best


@dataclass
class Index:
    """Items in the shapes in which workers seek them.

    ``hashes``, ``begin``, ``owners``: the rare words in ascending order, where each one's items begin in the list of items (one more), that list.
    ``filled``: for the first ``bits`` bits of a hash, whether a rare word has them. ``need``: the count of rare words that each item asks of a stretch of ``length`` words.
    ``anchor``, ``place``: each item's rarest word, and where it is first. ``short``: by length, hashes of short items.
    """

    items: list[Item]
    folded: np.ndarray | None
    vectors: np.ndarray | None
    hashes: np.ndarray
    begin: np.ndarray
    owners: np.ndarray
    bits: int
    filled: np.ndarray
    need: np.ndarray
    length: np.ndarray
    anchor: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, list[int]]]


def rows_of(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words that follow one another."""
    out = h[: max(0, len(h) - width + 1)].copy()
    for k in range(1, width):
        out = mixed(out) + h[k : k + len(out)]
    return out


def index_of(items: list[Item], vectors: np.ndarray | None, idf: np.ndarray | None) -> Index:
    """``vectors`` and ``idf`` are None if all items are short."""
    n = np.array([len(x.words) for x in items])
    long = np.flatnonzero(n >= SHORTEST).tolist()
    short: dict[int, tuple[np.ndarray, list[int]]] = {}
    for width in np.unique(n[n < SHORTEST]).tolist():
        some = sorted((int(rows_of(items[i].words, width)[0]), i) for i in np.flatnonzero(n == width).tolist())
        short[width] = np.array([k for k, _ in some], _U), [i for _, i in some]
    pairs, anchor, place = [np.zeros((0, 2), _U)], np.zeros(len(items), _U), np.zeros(len(items), np.int64)
    for i in long:
        words = items[i].words
        order = np.argsort(-idf[terms(words)], kind="stable")
        rare = np.unique(words[order[: int(np.ceil(RARE * len(words)))]])
        pairs.append(np.stack([rare, np.full(len(rare), i, _U)], axis=1))
        anchor[i], place[i] = words[order[0]], order[0]
    pair = np.concatenate(pairs)
    pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
    hashes, begin = np.unique(pair[:, 0], return_index=True)
    bits = max(12, int(len(hashes)).bit_length() + 6)
    filled = np.zeros(1 << bits, bool)
    filled[(hashes >> _U(64 - bits)).astype(np.int64)] = True
    folded = None
    if long:
        folded = np.zeros((len(items), vectors.shape[1]))
        for i in long:
            folded[i] = vectors[terms(items[i].words)].sum(axis=0)
        folded /= np.linalg.norm(folded, axis=1, keepdims=True) + 1e-12
    return Index(
        items, folded, vectors, hashes, np.append(begin, len(pair)), pair[:, 1].astype(np.int64), bits, filled,
        np.maximum(1, ((RARE - 1 + PARAPHRASE) * n).astype(np.int64)), n + n // 4, anchor, place, short,
    )


def hits(x: Index, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, place in ``h``) of each place of an item's rare word."""
    none = np.zeros(0, np.int64)
    if not len(x.hashes) or not len(h):
        return none, none, none
    hit = np.flatnonzero(x.filled[(h >> _U(64 - x.bits)).astype(np.int64)])
    at = np.searchsorted(x.hashes, h[hit]).clip(max=len(x.hashes) - 1)
    same = x.hashes[at] == h[hit]
    hit, at = hit[same], at[same]
    n_items = (x.begin[1:] - x.begin[:-1])[at]
    ends = np.cumsum(n_items)
    who = x.owners[np.repeat(x.begin[at] - (ends - n_items), n_items) + np.arange(int(n_items.sum()))]
    return np.repeat(np.searchsorted(first, hit, "right") - 1, n_items), who, np.repeat(hit, n_items)


def verbatim(x: Index, h: np.ndarray, first: np.ndarray, of: np.ndarray, who: np.ndarray, place: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) of each text and item that is in it word for word."""
    found = set()
    for width, (keys, which) in x.short.items():
        rows = rows_of(h, width)
        lo, hi = np.searchsorted(keys, rows, "left"), np.searchsorted(keys, rows, "right")
        for p in np.flatnonzero(hi > lo).tolist():
            d = int(np.searchsorted(first, p, "right")) - 1
            if p + width <= first[d + 1]:
                found.update((d, i) for i in which[lo[p] : hi[p]])
    at = np.flatnonzero(h[place] == x.anchor[who])
    start = place[at] - x.place[who[at]]
    at = at[(start >= first[of[at]]) & (start + np.array([len(x.items[i].words) for i in who[at].tolist()], np.int64) <= first[of[at] + 1])]
    for d, i, p in zip(of[at].tolist(), who[at].tolist(), (place[at] - x.place[who[at]]).tolist(), strict=True):
        words = x.items[i].words
        if h[p] == words[0] and (d, i) not in found and np.array_equal(h[p : p + len(words)], words):
            found.add((d, i))
    return found


def regions(x: Index, first: np.ndarray, of: np.ndarray, who: np.ndarray, place: np.ndarray) -> dict[tuple[int, int], list[list[int]]]:
    """By (text, item), bounds of all stretches of the item's ``length`` with as many of its rare words as it needs, joined if they overlap."""
    out: dict[tuple[int, int], list[list[int]]] = {}
    if not len(of):
        return out
    pair = of * len(x.items) + who
    order = np.argsort(pair, kind="stable")
    pair, place, who = pair[order], place[order], who[order]
    last = np.arange(len(pair)) + x.need[who] - 1
    ok = last < len(pair)
    last = last.clip(max=len(pair) - 1)
    ok &= (pair[last] == pair) & (place[last] - place < x.length[who])
    at = np.flatnonzero(ok)
    if not len(at):
        return out
    d, item = pair[at] // len(x.items), who[at]
    lo = np.maximum(first[d], place[last[at]] + 1 - x.length[item])
    hi = np.minimum(first[d + 1], place[at] + x.length[item])  # both rise within a pair
    new = np.ones(len(at), bool)
    new[1:] = (pair[at][1:] != pair[at][:-1]) | (lo[1:] > hi[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    for key in zip(d[begin].tolist(), item[begin].tolist(), lo[begin].tolist(), hi[end].tolist(), strict=True):
        out.setdefault(key[:2], []).append([*key[2:]])
    return out


def find(x: Index, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(text, item, cosine, lcs, answer) of each text and item in it; ``h`` are the texts' words, ``first`` the first word of each (texts + 1)."""
    places = hits(x, h, first)
    got = {pair: (1.0, 1.0, 1.0) for pair in verbatim(x, h, first, *places)}

    @lru_cache(256)
    def prepared(item: int) -> tuple[dict[int, int], set[int], int]:
        words = x.items[item].words.tolist()
        return masks_of(words), set(x.items[item].answer.tolist()), len(words)

    for (d, item), bounds in regions(x, first, *places).items():
        if (d, item) in got:
            continue
        best = (False, 0.0, 0.0, 0.0)
        for lo, hi in bounds:
            cosine = best_cosine(x.vectors, terms(h[lo:hi]), x.folded[item], len(x.items[item].words))
            if cosine >= COSINE:
                share, answer = best_stretch(*prepared(item), h[lo:hi].tolist())
                best = max(best, (leaks(share, answer), share, answer, cosine))
        if best[0]:
            got[d, item] = (best[3], best[1], best[2])
    return [(*pair, *got[pair]) for pair in sorted(got)]


def search(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, item, cosine, lcs, answer of each document and item in it."""
    table = docs.sparkSession.sparkContext.broadcast(index)
    item_type = pa.array([x.item_id for x in index.items]).type
    kind = {"int64": "long", "int32": "int"}.get(str(item_type), "string")

    def make():
        def part(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            x = table.value
            h, _, _, first = word_hashes(*lowered(batch.column("text")), PUNCTUATION)
            rows = find(x, h, first)
            if not rows:
                return None
            row, item, *scores = zip(*rows, strict=True)
            ids = pa.array([x.items[i].item_id for i in item], item_type)
            rounded = [pa.array([round(float(v), 6) for v in c]) for c in scores]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), ids, *rounded], ["doc_id", "item", "cosine", "lcs", "answer"])

        return part

    return arrow_map(docs, make, f"doc_id {id_type(docs, 'doc_id')}, item {kind}, cosine double, lcs double, answer double", "text")


def indexes(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark's items, ``MOST_ITEMS`` of them and ``MOST_BYTES`` of their texts at once or about so, each with what the documents' terms weigh."""
    base = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("item is not null")
    size = base.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // MOST_ITEMS), -(-size["bytes"] // MOST_BYTES))
    idf = vectors = None
    for k in range(parts):
        rows = base.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else base
        items = items_of(sorted(((r["item"], r["text"]) for r in rows.collect()), key=lambda r: (r[0], r[1])))
        if any(len(x.words) >= SHORTEST for x in items) and idf is None:
            idf = weights(document_frequencies(docs))
            vectors = latent_terms(passage_products(docs, idf), idf)
        if items:
            yield index_of(items, vectors, idf)


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer: each document that holds a benchmark item, whole, edited or paraphrased.

    Null or empty documents hold nothing; null item ids and empty items are passed over; items of fewer than ``SHORTEST`` words are found word for word; items of equal texts are
    found each; repeated rows of documents give repeated rows. Either table may be empty: no rows. More items than go into a pass take several passes.
    """
    docs, kind = pick(df, id_col, text_col), benchmark.schema[item_col].dataType
    out, before = None, None
    for index in indexes(docs, benchmark, item_col, item_text):
        if before is not None:  # there are several: each is written, so that the driver has the items of two at the most
            out = written(before, "leaks") if out is None else out.unionAll(written(before, "leaks"))
        before = search(docs, index)
    if before is None:
        before = docs.where("false").select("doc_id", F.lit(None).cast(kind).alias("item"), *(F.lit(0.0).alias(c) for c in ("cosine", "lcs", "answer")))
    out = before if out is None else out.unionAll(written(before, "leaks"))
    return out.select("doc_id", F.col("item").cast(kind).alias("item_id"), "cosine", "lcs", "answer")


def drop_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no benchmark item, with all columns: a filter without a shuffle, so that each row stands for itself, whatever its id.

    Null or empty texts stay. Either table may be empty.
    """
    docs, out = pick(df, id_col, text_col), df
    columns, text, schema = df.columns, unused(df, "checked"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def without(rows: DataFrame, index: Index) -> DataFrame:
        table = rows.sparkSession.sparkContext.broadcast(index)

        def make():
            def part(batch: pa.RecordBatch) -> pa.RecordBatch:
                h, _, _, first = word_hashes(*lowered(batch.column(text)), PUNCTUATION)
                stays = np.ones(batch.num_rows, bool)
                stays[[r[0] for r in find(table.value, h, first)]] = False
                return batch.select(columns).filter(pa.array(stays))

            return part

        return arrow_map(rows.withColumn(text, F.coalesce(rows[text_col].cast("string"), F.lit(""))), make, schema, text)

    for k, index in enumerate(indexes(docs, benchmark, item_col, item_text)):
        out = without(written(out, "decontaminated") if k else out, index)
    return out
