"""Language-model scores of texts: a causal self-attention model over subword ids, trained in numpy, beside a unigram base over words.

The model. A token's id has an embedding; queries, keys, values and the token's own part of the hidden layer are products of it. A query attends to the ``CONTEXT`` tokens before
its window and to those of the window up to itself, with a learned bias for each distance; the hidden layer takes the token and what it attended to. The next id's probability
is a product along its path in a Huffman tree of the ids' counts: logistic units at the tree's ``NODES`` largest nodes, counts below them. A unit adds a direct path from the token
before, which is the smoothed log-odds of their counts, and for the ``UPPER`` largest nodes the hidden layer. So the probabilities of all ids add up to 1, and the model begins as the counts
of pairs.

Texts are cut in windows of ``STRIDE`` tokens, which overlap by the context: each token is scored once, windows are batched and masked. Every text ends with an end id, which also
stands before its first token.

Training covers all training documents: id and word counts and gradients take every token. Each task trains on what it reads, the parameters are
averaged, weighted by tokens; this goes in two rounds over different documents, so that the averaged models start from a common one. Nothing is bounded by a number of rows.

The base: log10 of (c + 0.5) / (N + 0.5 * (V + 1)) over words and the end, by words' 64-bit hashes (see ``word_hashes``). The most frequent words, ``HEAD`` at the most, are looked
up in a table that every task has; the others are joined, so no frequent word is shuffled by document.

Null texts count as empty: an end id alone. Rows that repeat, or share an id, are scored each; a null id is hashed as the empty text. An empty table gives no rows; without training documents the
counts are 0. Other columns don't matter, whatever they are called.
"""

from __future__ import annotations

import copy
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import SLICE, buffer_of, chunks, id_type, in_few_tasks, keep_freed, pick, release, table_rows, table_sum, vocabulary, word_hashes, written
from millrace.llm.bpe import WHITE
from millrace.llm.token_counts import lengths

#: Tokens of a window, of the context before it, and of a row of the table of ids.
STRIDE = CONTEXT = 16
ROW_TOKENS = 8192
#: Sizes of embeddings and of the hidden layer, units of the tree, those that see the hidden layer, ids that have an embedding of their own, embeddings that the others share.
WIDTH, HIDDEN, NODES, UPPER, OWN, SHARED = 16, 20, 1023, 63, 2048, 128
#: Tokens that the counts of all ids weigh beside those after one token, at each unit.
SMOOTH = 4.0
#: Windows of one step; of so many documents one is in the first round; rates of learning of the rounds.
STEP, FIRST, RATES = 256, 4, (0.01, 0.005)
#: Words whose counts every task has, at the most.
HEAD = 1_000_000
#: Different words that a task counts up before it gives them out.
ENTRIES = 1 << 20
#: Parts of a unit in which parameters are summed.
UNIT = 2.0**-10
#: Windows that are scored at once, tokens that are counted at once, and characters of a text that are encoded at once.
BATCH, COUNTED, PART = 1024, 1 << 20, 1 << 20


# --- subword ids


class Ids:
    """Ids of a text under a tiktoken vocabulary (unsigned, 16 bits if they suffice). Very long texts are encoded in parts, cut before white space, where no token of the pattern reaches over."""

    def __init__(self, path: str):
        self.encoding = lengths(path).encoding
        self.end = self.encoding.n_vocab
        self.dtype, self.code = ("<u2", "H") if self.end < 1 << 16 else ("<u4", "I")
        self.edge = re.compile(f"[^{WHITE}][{WHITE}]").search

    def of(self, text: str) -> np.ndarray:
        out, a = array(self.code), 0
        while len(text) - a > PART and (found := self.edge(text, a + PART)):
            b = found.start() + 1
            out.extend(array(self.code, self.encoding.encode_ordinary(text[a:b])))
            a = b
        out.extend(array(self.code, self.encoding.encode_ordinary(text[a:])))
        return np.frombuffer(out, self.dtype)


@lru_cache(2)
def ids(path: str) -> Ids:
    return Ids(path)


# --- the tree of ids and the model


@dataclass
class Tree:
    """For each id: its units (``path``, one past the last where there is none), signs, the log of its share below the last unit, and the number of the subtree there; for each unit the share of its first side."""

    path: np.ndarray
    sign: np.ndarray
    below: np.ndarray
    subtree: np.ndarray
    first: np.ndarray

    def upper(self) -> int:
        return min(UPPER, len(self.first))


def huffman(counts: np.ndarray, nodes: int) -> Tree:
    """The tree of ids whose counts are one more than given, and its ``nodes`` largest inner nodes."""
    size = [int(c) + 1 for c in counts]
    n = len(size)
    heap = [(s, i) for i, s in enumerate(size)]
    heapq.heapify(heap)
    parent, side = [0] * (2 * n - 1), [0] * (2 * n - 1)
    children = {}
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        k = len(size)
        size.append(a + b)
        children[k] = (x, y)
        parent[x], parent[y], side[x], side[y] = k, k, 1, -1
        heapq.heappush(heap, (a + b, k))
    # the largest inner nodes: a node's parent is larger, or as large and made later
    units = {k: i for i, k in enumerate(sorted(children, key=lambda k: (-size[k], -k))[:nodes])}
    paths, below, subtree, tops = [], np.zeros(n), np.zeros(n, np.int64), {}
    for i in range(n):
        at, steps, top = i, [], None
        while at != len(size) - 1:
            up = parent[at]
            if up in units:
                top = at if top is None else top
                steps.append((units[up], side[at]))
            at = up
        below[i] = 0 if top is None else np.log(size[i] / size[top])
        subtree[i] = tops.setdefault(top, len(tops))
        paths.append(steps)
    longest = max(1, max(map(len, paths)))
    path, sign = np.full((n, longest), len(units), np.int64), np.zeros((n, longest), np.float32)
    for i, steps in enumerate(paths):
        for j, (u, s) in enumerate(steps):
            path[i, j], sign[i, j] = u, s
    return Tree(path, sign, below, subtree, np.array([size[children[k][0]] / size[k] for k in units]))


def direct_path(pairs: np.ndarray, tree: Tree) -> np.ndarray:
    """Log-odds of each unit after each embedding, from the counts of subtrees after embeddings."""
    _, one = np.unique(tree.subtree, return_index=True)  # an id of each subtree
    sides = np.zeros((2, len(tree.first) + 1, len(pairs)))
    for g, i in enumerate(one.tolist()):
        for u, s in zip(tree.path[i].tolist(), tree.sign[i].tolist(), strict=True):
            if s:
                sides[int(s < 0), u] += pairs[:, g]
    first, second = sides[:, :-1]
    p = tree.first[:, None]
    return np.ascontiguousarray(np.log((first + SMOOTH * p) / (second + SMOOTH * (1 - p))).T.astype(np.float32))


def embedding_of(counts: np.ndarray, end: int, own: int = OWN, shared: int = SHARED) -> np.ndarray:
    """Which embedding each id has: the most frequent ones (and the end) their own."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    order = np.concatenate([[end], order[order != end]])
    out = own + np.arange(len(counts)) % shared
    out[order[:own]] = np.arange(min(own, len(counts)))
    return out.astype(np.int32)


def first_parameters(units: int, upper: int, seed: int = 13) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

    return {
        "embedding": rng.standard_normal((units, WIDTH)).astype(np.float32) * np.float32(0.5),
        "query": draw(WIDTH, WIDTH) / np.float32(np.sqrt(WIDTH)), "key": draw(WIDTH, WIDTH), "value": draw(WIDTH, WIDTH), "own": draw(WIDTH, HIDDEN), "seen": draw(WIDTH, HIDDEN),
        "distance": np.zeros(STRIDE + CONTEXT, np.float32), "hidden": np.zeros(HIDDEN, np.float32), "unit": np.zeros((HIDDEN, upper), np.float32), "bias": np.zeros(upper, np.float32),
    }


#: Distance of each key of a window from each query; those ahead of it are masked.
_FAR = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(CONTEXT + STRIDE)[None, :]


class Model:
    """``units``: the embedding of each id; ``direct``: see ``direct_path``."""

    def __init__(self, parameters: dict[str, np.ndarray], tree: Tree, units: np.ndarray, direct: np.ndarray):
        self.w, self.tree, self.units, self.direct = parameters, tree, units, direct
        n = tree.upper()
        on = (tree.path < n) & (tree.sign != 0)
        width = max(1, int(on.sum(axis=1).max()))
        # the upper units of a path come first; missing ones are one of an overwhelming value, beside those that there are
        order = np.argsort(~on, axis=1, kind="stable")[:, :width]
        there = np.take_along_axis(on, order, 1)
        self.high = np.where(there, np.take_along_axis(tree.path, order, 1), n).astype(np.int32)
        self.sign = np.where(there, np.take_along_axis(tree.sign, order, 1), 1).astype(np.float32)
        self.log_odds = np.concatenate([direct[:, :n], np.full((len(direct), 1), 60, np.float32)], axis=1)
        # below them the last token decides alone: a subtree's log-probability there, after each embedding
        self.subtree = tree.subtree.astype(np.int32)
        _, one = np.unique(tree.subtree, return_index=True)
        self.rest = np.zeros((len(direct), len(one)), np.float32)
        for g, i in enumerate(one.tolist()):
            for u, sign in zip(tree.path[i].tolist(), tree.sign[i].tolist(), strict=True):
                if sign and u >= n:
                    self.rest[:, g] -= np.log1p(np.exp(-sign * direct[:, u]))
        self.places = np.arange(len(direct) * WIDTH).reshape(-1, WIDTH)
        self.tables()

    def tables(self) -> None:
        """What depends on a token's embedding alone, for every embedding at once."""
        w = self.w
        e = w["embedding"]
        self.q, self.k, self.v, self.x = e @ w["query"], e @ w["key"], e @ w["value"], e @ w["own"] + w["hidden"]
        none = np.zeros((HIDDEN, 1), np.float32)
        self.out, self.level = np.concatenate([w["unit"], none], axis=1), self.log_odds + np.concatenate([w["bias"], none[0]])
        self.mask = np.where(_FAR >= 0, np.exp(w["distance"])[np.maximum(_FAR, 0)], 0).astype(np.float32)

    def forward(self, before: np.ndarray, after: np.ndarray) -> dict[str, np.ndarray]:
        """``before``, ``after``: the embeddings' numbers of each window's context and tokens (windows x tokens)."""
        both = np.concatenate([before, after], axis=1)
        return self.attended(self.k.take(both, axis=0), self.v.take(both, axis=0), after)

    def along(self, lines: np.ndarray) -> dict[str, np.ndarray]:
        """``forward`` where a window's context is the line before its own (lines x tokens), for the lines from the second one on."""

        def two(x: np.ndarray) -> np.ndarray:  # each line's rows, and those of the next one, lie together
            return np.lib.stride_tricks.as_strided(x, (len(lines) - 1, 2 * STRIDE, WIDTH), x.strides, writeable=False)

        return self.attended(two(self.k.take(lines, axis=0)), two(self.v.take(lines, axis=0)), lines[1:])

    def attended(self, k: np.ndarray, v: np.ndarray, after: np.ndarray) -> dict[str, np.ndarray]:
        """``forward`` from the keys and values of each window's context and tokens; ``z`` is without the units' own levels."""
        q = self.q.take(after, axis=0)
        e = np.matmul(q, k.transpose(0, 2, 1))
        np.clip(e, -87, 30, out=e)
        np.exp(e, out=e)
        e *= self.mask
        total = (e.reshape(-1, e.shape[2]) @ np.ones(e.shape[2], np.float32))[:, None]
        seen = np.matmul(e, v).reshape(-1, WIDTH)
        seen /= total
        h = seen @ self.w["seen"]
        h += self.x.take(after.ravel(), axis=0)
        np.maximum(h, 0, out=h)
        return {"q": q, "k": k, "v": v, "e": e, "total": total, "seen": seen, "h": h, "z": h @ self.out}

    def odds(self, z: np.ndarray, last: np.ndarray, nexts: np.ndarray) -> np.ndarray:
        """At each upper unit on the next ids' paths, how much likelier the other side is; about 0 where a path has no more of them."""
        return self.odds_at(z, last, nexts)[0]

    def odds_at(self, z: np.ndarray, last: np.ndarray, nexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``odds``, the places of these units in ``z``, and the paths' signs there."""
        high = self.high.take(nexts, axis=0)
        value = self.level.take(last.astype(np.int32)[:, None] * self.level.shape[1] + high)
        high += np.arange(len(z), dtype=np.int32)[:, None] * z.shape[1]
        value += z.take(high)
        sign = self.sign.take(nexts, axis=0)
        value *= sign
        np.clip(value, -60, 60, out=value)
        np.negative(value, out=value)
        return np.exp(value, out=value), high, sign

    def lower(self, last: np.ndarray, nexts: np.ndarray) -> np.ndarray:
        """The part of the next ids' log-probabilities that lies below the upper units."""
        return self.tree.below.take(nexts) + self.rest.take(last.astype(np.int64) * self.rest.shape[1] + self.subtree.take(nexts))

    def log_probabilities(self, before: np.ndarray, after: np.ndarray, nexts: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of each window's next ids; 0 where ``nexts`` is negative."""
        return self.logs_from(self.forward(before, after)["z"], after.ravel(), nexts.ravel())

    def logs_from(self, z: np.ndarray, last: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.maximum(y, 0)
        odds = self.odds(z, last, at)
        odds += 1
        steps = np.zeros(len(odds))
        for k in range(0, odds.shape[1], 10):  # the product of 10 factors of up to e^60 has its place in a double
            product = odds[:, k].astype(np.float64)
            for j in range(k + 1, min(k + 10, odds.shape[1])):
                product *= odds[:, j]
            steps += np.log(product)
        return np.where(y >= 0, self.lower(last, at) - steps, 0)

    def line_logs(self, lines: np.ndarray, nexts: np.ndarray) -> np.ndarray:
        """``log_probabilities`` summed for each line from the second one on, whose context is the line before (``nexts`` from the second line on, negative: none)."""
        out = [np.zeros(0)]
        for a in range(0, len(nexts), STEP):  # so many at once stay in the processor's cache
            part, y = lines[a : a + STEP + 1], nexts[a : a + STEP].ravel()
            out.append(self.logs_from(self.along(part)["z"], part[1:].ravel(), y).reshape(-1, STRIDE).sum(axis=1))
        return np.concatenate(out)

    def gradients(self, before: np.ndarray, after: np.ndarray, nexts: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The loss (negative log-probability) of a batch and its gradients, for each token."""
        count = max(1, int((nexts >= 0).sum()))
        lines = np.stack([before, after], axis=1).reshape(-1, STRIDE)
        live = np.stack([nexts, np.full_like(nexts, -1)], axis=1).reshape(-1, STRIDE)[:-1]
        return -float(self.log_probabilities(before, after, nexts).sum()) / count, self.descent(lines, live, count)

    def descent(self, lines: np.ndarray, nexts: np.ndarray, count: int) -> dict[str, np.ndarray]:
        """The gradients of the loss over ``count``, where a window's context is the line before its own (lines x tokens; ``nexts`` from the second line on, negative: none)."""
        y, w = nexts.ravel(), self.w
        g = self.along(lines)
        odds, places, sign = self.odds_at(g["z"], lines[1:].ravel(), np.maximum(y, 0))
        odds /= 1 + odds
        odds *= sign
        odds *= np.where(y >= 0, np.float32(-1 / count), np.float32(0))[:, None]
        # the unit past the last, which missing ones are, has no weights
        dz = g["z"]
        dz.fill(0)
        dz.ravel()[places] = odds
        ones = np.ones(len(dz), np.float32)
        out = {"unit": (g["h"].T @ dz)[:, :-1], "bias": (ones @ dz)[:-1]}
        dh = dz @ self.out.T
        dh *= g["h"] > 0
        out |= {"hidden": ones @ dh, "seen": g["seen"].T @ dh}
        da = (dh @ w["seen"].T).reshape(-1, STRIDE, WIDTH)
        p = g["e"]
        p /= g["total"].reshape(-1, STRIDE, 1)
        ds = np.matmul(da, g["v"].transpose(0, 2, 1))
        # what a query gives to all its keys: their mean by p, which is what it attended to
        ds -= np.einsum("wqd,wqd->wq", da, g["seen"].reshape(da.shape))[:, :, None]
        ds *= p
        far = (np.ones(len(ds), np.float32) @ ds.reshape(len(ds), -1)).reshape(_FAR.shape)
        out["distance"] = np.bincount(np.maximum(_FAR, 0).ravel(), np.where(_FAR >= 0, far, 0).ravel(), STRIDE + CONTEXT).astype(np.float32)
        # of each line's tokens: as queries, as the hidden layer's own, as keys and as values of two windows
        rows = {"query": np.matmul(ds, g["k"]).reshape(-1, WIDTH), "own": dh}
        for name, x in (("key", np.matmul(ds.transpose(0, 2, 1), g["q"])), ("value", np.matmul(p.transpose(0, 2, 1), da))):
            part = np.empty((*lines.shape, WIDTH), np.float32)
            part[0] = 0
            part[1:] = x[:, STRIDE:]
            part[:-1] += x[:, :STRIDE]
            rows[name] = part.reshape(-1, WIDTH)
        at = lines.ravel()
        e = w["embedding"].take(at, axis=0)
        out |= {name: e[len(e) - len(x) :].T @ x for name, x in rows.items()}
        de = rows["key"] @ w["key"].T
        de += rows["value"] @ w["value"].T
        de[STRIDE:] += rows["query"] @ w["query"].T
        de[STRIDE:] += dh @ w["own"].T
        # summed by embedding
        places = self.places.take(at, axis=0)
        out["embedding"] = np.bincount(places.ravel(), de.ravel(), self.places.size).reshape(self.places.shape)
        return out


class Adam:
    """Steps of parameters that lie one after the other in ``flat``."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.t = flat, rate, 0
        self.m, self.s, self.free = (np.zeros_like(flat) for _ in range(3))

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        x = self.free
        np.subtract(g, self.m, out=x)
        x *= np.float32(0.1)
        self.m += x
        np.multiply(g, g, out=x)
        x -= self.s
        x *= np.float32(0.01)
        self.s += x
        np.multiply(self.s, np.float32(1 / (1 - 0.99**self.t)), out=x)
        np.sqrt(x, out=x)
        x += np.float32(1e-8)
        np.divide(self.m, x, out=x)
        x *= np.float32(self.rate / (1 - 0.9**self.t))
        self.flat -= x


def parted(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Views of parameters that lie one after the other, of the shapes of others."""
    ends = np.cumsum([x.size for x in like.values()])
    return {k: flat[end - x.size : end].reshape(x.shape) for (k, x), end in zip(like.items(), ends.tolist(), strict=True)}


def windows(row: np.ndarray, skip: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """A row's ids in windows: (windows + 1) x STRIDE ids, of which the first line is context, and the ids that come next in each window (negative: none).

    ``row``: ``skip`` tokens of context (none at a text's beginning, where end ids stand in), then tokens that are to be scored.
    """
    fresh = len(row) - skip
    n = -(-fresh // STRIDE)
    # the token before the first fresh one is the last of the context's tokens that is also an input
    inputs = np.full((n + 1) * STRIDE, end, np.int64)
    known = row[:-1][max(0, skip - 1 - CONTEXT) :]
    begin = CONTEXT - min(skip - 1, CONTEXT) if skip else CONTEXT + 1
    inputs[begin : begin + len(known)] = known
    nexts = np.full(n * STRIDE, -1, np.int64)
    nexts[:fresh] = row[skip:]
    return inputs.reshape(-1, STRIDE), nexts.reshape(-1, STRIDE)


# --- passes over the corpus


def _steps_of(n):
    """Counts on a scale of eighths of a doubling."""
    return F.floor(F.log2(n) * 8)


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n): the hash of each word of the texts and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        keep_freed()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(words, kind="stable")
            words, counts = words[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            return words[first], np.add.reduceat(counts, first)

        def out(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in batches:
            for part in chunks(batch, "text"):
                hashes = word_hashes(*buffer_of(part.column("text")))[0]
                if len(hashes):
                    held.append(np.unique(hashes, return_counts=True))
                if sum(len(w) for w, _ in held) > ENTRIES:
                    held = [merged()]
                    if len(held[0][0]) > ENTRIES // 2:
                        yield out(*held.pop())
        if held:
            yield out(*merged())

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Base:
    """Frequent words (sorted hashes) with the logs of their counts and a half, the step from which words are frequent, and the counts of all."""

    words: np.ndarray
    logs: np.ndarray
    least: int | None
    end: int
    tokens: int
    different: int


def base_of(counts: DataFrame, ends: int, head: int) -> Base:
    """From the words' counts and the number of training documents, each of which has an end."""
    step = _steps_of(F.col("n"))
    sizes = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect(), key=lambda r: -r["step"])  # a few hundred rows
    got, least = 0, None
    for r in sizes:
        if got + r["k"] > head:
            break
        got, least = got + r["k"], r["step"]
    words, logs = np.zeros(0, np.uint64), np.zeros(0)
    if least is not None:
        t = counts.where(step >= least).toArrow()
        words = np.asarray(t["word"]).view(np.uint64)
        order = np.argsort(words)
        words, logs = words[order], np.log10(np.asarray(t["n"])[order] + 0.5)
    return Base(words, logs, least, ends, sum(r["n"] for r in sizes) + ends, sum(r["k"] for r in sizes) + bool(ends))


def encoded(docs: DataFrame, base: Base, path: str, kind: str) -> DataFrame:
    """One pass over the texts. Rows of three sorts, by ``row``: a document's (doc_id, held_out, n_tokens, known, logs of the frequent words), a stretch of its ids
    (ids, after ``skip`` of context), and a word that isn't frequent (word, n)."""
    shared = docs.sparkSession.sparkContext.broadcast(base)
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "ids", "skip", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        known, encode = shared.value, ids(path)
        end = np.array([encode.end], encode.dtype)

        def put(m: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(m, types[c])) for c in names], names)

        for batch in batches:
            types = {"row": pa.int64(), "doc_id": batch.schema.field("doc_id").type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "logs": pa.float64(), "ids": pa.binary(), "skip": pa.int64(), "word": pa.int64(), "n": pa.int64()}
            for part in chunks(batch, "text"):
                m, row, held = part.num_rows, np.asarray(part.column("row")), part.column("held_out")
                hashes, _, _, first = word_hashes(*buffer_of(part.column("text")))
                doc = np.repeat(np.arange(m), np.diff(first))
                words, back = np.unique(hashes, return_inverse=True)
                at = np.minimum(np.searchsorted(known.words, words), max(0, len(known.words) - 1))
                there = known.words[at] == words if len(known.words) else np.zeros(len(words), bool)
                logs = np.where(there, known.logs[at], 0) if len(known.words) else np.zeros(len(words))
                frequent = there[back]
                yield put(
                    m, row=part.column("row"), doc_id=part.column("doc_id"), held_out=held, n_tokens=pa.array(np.diff(first).astype(np.int64) + 1),
                    known=pa.array(np.bincount(doc[frequent], minlength=m) + (known.end > 0)), logs=pa.array(np.bincount(doc, logs[back], m) + np.log10(known.end + 0.5)),
                )
                if not frequent.all():
                    pairs = doc[~frequent] * len(words) + back[~frequent]
                    pairs, n = np.unique(pairs, return_counts=True)
                    yield put(len(n), row=pa.array(row[pairs // len(words)]), word=pa.array(words[pairs % len(words)].view(np.int64)), n=pa.array(n))
                out: list[tuple[int, bytes, int, bool]] = []
                for r, text, h in zip(row.tolist(), part.column("text").to_pylist(), held.to_pylist(), strict=True):
                    got = np.concatenate([encode.of(text), end])
                    for a in range(0, len(got), ROW_TOKENS):
                        skip = min(a, CONTEXT + 1)
                        out.append((r, got[a - skip : a + ROW_TOKENS].tobytes(), skip, h))
                yield put(len(out), **{c: pa.array(x, types[c]) for c, x in zip(("row", "ids", "skip", "held_out"), zip(*out, strict=True), strict=True)})

    return docs.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, ids binary, skip long, word long, n long")


def _training(table: DataFrame) -> DataFrame:
    return table.where(F.col("ids").isNotNull() & ~F.col("held_out"))


def _whole(size: int) -> int:
    return -(-size // SLICE) * SLICE


def _collected(rows: DataFrame, size: int, kind: str) -> np.ndarray:
    out = np.zeros(_whole(size), np.int64)
    for r in rows.collect():  # a table of a fixed size
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], kind)
    return out[:size]


def id_counts(table: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often training documents have each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_whole(size), np.int64)
        for batch in batches:
            found, n = [], 0
            for k, (row, skip) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("skip").to_pylist(), strict=True)):
                found.append(np.frombuffer(row, dtype)[skip:])
                n += len(found[-1])
                if n > COUNTED or k + 1 == batch.num_rows:
                    counts += np.bincount(np.concatenate(found), minlength=len(counts))
                    found, n = [], 0
        if counts.any():
            yield table_rows(counts, "<i8")

    rows = in_few_tasks(_training(table).select("ids", "skip")).mapInArrow(run, "slice int, counts binary")
    return _collected(table_sum(rows, "<i8"), size, "<i8")


def trained(table: DataFrame, model: Model, end: int, dtype: str, round_: int) -> Model:
    """The model after one round: tasks train on by themselves, then parameters are averaged."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    first = F.pmod(F.xxhash64("row"), F.lit(FIRST)) == 0
    rows = _training(table).where(first if round_ == 0 else ~first).select("ids", "skip")
    rate, total = RATES[round_], sum(x.size for x in model.w.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        keep_freed()
        start = shared.value
        m = copy.copy(start)
        w = np.concatenate([x.ravel() for x in start.w.values()])
        m.w = parted(w, start.w)
        adam, held, count, tokens = Adam(w, rate), [], 0, 0
        none = np.full((1, STRIDE), -1)

        def step() -> int:
            lines, nexts = (np.concatenate(x) for x in zip(*held, strict=True))
            n = int((nexts >= 0).sum())
            m.tables()
            g = m.descent(lines, nexts[1:], n)
            adam.step(np.concatenate([g[k].ravel() for k in m.w], dtype=np.float32, casting="same_kind"))
            held.clear()
            return n

        for batch in batches:
            for row, skip in zip(batch.column("ids").to_pylist(), batch.column("skip").to_pylist(), strict=True):
                inputs, nexts = windows(np.frombuffer(row, dtype), skip, end)
                inputs, a = m.units.take(inputs), 0
                while a < len(nexts):
                    b = min(len(nexts), a + STEP - count)
                    held.append((inputs[a : b + 1], np.concatenate([none, nexts[a:b]])))  # no token is to come after a first line's
                    a, count = b, count + b - a
                    if count == STEP:
                        tokens, count = tokens + step(), 0
        if held:
            tokens += step()
        if tokens:
            flat = np.zeros(_whole(total + 1))
            flat[:total] = w
            flat[total] = 1
            yield table_rows(flat * tokens, "<f8")

    sums = _collected(table_sum(in_few_tasks(rows).mapInArrow(run, "slice int, counts binary"), "<f8", unit=UNIT), total + 1, "<i8")
    if not sums[total]:
        return model
    return Model(parted((sums[:total] / sums[total]).astype(np.float32), model.w), model.tree, model.units, model.direct)


def pair_counts(table: DataFrame, units: np.ndarray, subtree: np.ndarray, end: int, dtype: str) -> np.ndarray:
    """How often ids of each subtree come after each embedding in training documents."""
    shape = (int(units.max()) + 1, int(subtree.max()) + 1)
    shared = table.sparkSession.sparkContext.broadcast((units.astype(np.int64), subtree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = shared.value
        after = after.astype(np.int64)
        counts = np.zeros(_whole(shape[0] * shape[1]), np.int64)
        for batch in batches:
            found, n = [], 0
            for k, (row, skip) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("skip").to_pylist(), strict=True)):
                row = np.frombuffer(row, dtype)
                last = row[skip - 1 : -1] if skip else np.concatenate([np.array([end], row.dtype), row[:-1]])
                found.append(before[last] * shape[1] + after[row[skip:]])
                n += len(last)
                if n > COUNTED or k + 1 == batch.num_rows:
                    counts += np.bincount(np.concatenate(found), minlength=len(counts))
                    found, n = [], 0
        while counts.any():  # in pieces that fit in 32 bits: one, unless a task has read billions of pairs
            part = np.minimum(counts, (1 << 32) - 1)
            yield table_rows(part, "<u4")
            counts -= part

    rows = in_few_tasks(_training(table).select("ids", "skip")).mapInArrow(run, "slice int, counts binary")
    return _collected(table_sum(rows, "<u4"), shape[0] * shape[1], "<i8").reshape(shape)


def model_of(table: DataFrame, end: int, dtype: str) -> Model:
    """A model trained on the documents of a table of ids that aren't held out."""
    counts = id_counts(table, end + 1, dtype)
    tree = huffman(counts, NODES)
    units = embedding_of(counts, end)
    direct = direct_path(pair_counts(table, units, tree.subtree, end, dtype), tree)
    model = Model(first_parameters(len(direct), tree.upper()), tree, units, direct)
    for k in range(len(RATES)):
        model = trained(table, model, end, dtype, k)
    return model


def row_scores(table: DataFrame, model: Model, end: int, dtype: str) -> DataFrame:
    """Rows (row, score): the log10 probability of each stretch of ids."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        keep_freed()
        m, none = shared.value, np.full((1, STRIDE), -1)
        for batch in batches:
            rows = list(zip(batch.column("ids").to_pylist(), batch.column("skip").to_pylist(), strict=True))
            place: dict[tuple[bytes, int], int] = {}
            which = np.array([place.setdefault(r, len(place)) for r in rows], np.int64)  # copies are scored once
            scores, held, count = [], [], 0
            for k, (row, skip) in enumerate(place):
                inputs, nexts = windows(np.frombuffer(row, dtype), skip, end)
                held.append((m.units.take(inputs), np.concatenate([none, nexts])))  # no token is to come after a first line's
                count += len(inputs)
                if count < BATCH and k + 1 < len(place):
                    continue
                lines, nexts = (np.concatenate(x) for x in zip(*held, strict=True))
                got = np.concatenate([[0], m.line_logs(lines, nexts[1:])])
                edges = np.cumsum([0] + [len(n) for _, n in held])
                scores.append(np.add.reduceat(got, edges[:-1]) / np.log(10))
                held, count = [], 0
            if len(which):
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(scores)[which])], ["row", "score"])

    return table.where("ids is not null").select("row", "ids", "skip").mapInArrow(run, "row long, score double")


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, fold: int = 1, folds: int = 5, head: int = HEAD) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    ``held_out``: crc32 of the id as text leaves ``fold`` when divided by ``folds``; all counts and the model come from the others. ``n_tokens`` are words and the end,
    ``n_known`` those that training documents have, ``train_tokens`` how many these have in all. Scores are log10 probabilities of the whole text.
    """
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    kind, encode = id_type(df, id_col), ids(path)
    docs = pick(df, id_col, text_col)
    docs = docs.withColumn("held_out", F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % folds == fold)
    train = docs.where(~F.col("held_out"))
    counts = written(word_counts(train), "lm-words")
    base = base_of(counts, train.count(), head)
    # rows are numbered once, when the table is written
    table = written(encoded(docs.withColumn("row", F.monotonically_increasing_id()), base, path, kind), "lm-ids")
    model = model_of(table, encode.end, encode.dtype)
    rare = counts if base.least is None else counts.where(_steps_of(F.col("n")) < base.least)
    found = table.where("word is not null").select("row", "word", F.col("n").alias("times")).join(rare, "word", "left")
    c = F.coalesce("n", F.lit(0))
    tail = found.select("row", F.when(c > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10(c + 0.5)).alias("logs"))
    none = F.lit(None)
    parts = (
        table.where("n_tokens is not null").select("row", "doc_id", "held_out", "n_tokens", "known", "logs", none.cast("double").alias("score"))
        .unionByName(tail.select("row", none.cast(kind).alias("doc_id"), none.cast("boolean").alias("held_out"), none.cast("long").alias("n_tokens"), "known", "logs", none.cast("double").alias("score")))
        .unionByName(row_scores(table, model, encode.end, encode.dtype).select("row", none.cast(kind).alias("doc_id"), none.cast("boolean").alias("held_out"), none.cast("long").alias("n_tokens"), none.cast("long").alias("known"), none.cast("double").alias("logs"), "score"))
    )
    out = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("logs").alias("logs"), F.sum("score").alias("score"))
    total = F.log10(F.lit(base.tokens + 0.5 * (base.different + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(base.tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * total).alias("base_score"), "score")
