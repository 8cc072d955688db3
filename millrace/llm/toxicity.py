"""Toxicity: a classifier chain. Each category's linear model sees the text's features and the probabilities of the categories before it.

A later model is trained on out-of-fold probabilities of the earlier ones, so it learns from scores such as those of unseen texts. A fold's models know nothing of its rows: their words
are chosen among the other folds' rows too.

Training takes at most ``SAMPLE`` rows, of as many labelled ids (those of the smallest hashes; where ids have several texts, the rows of the smallest hashes), the only bound here that
doesn't grow with the data; every row is scored in one pass over whole texts without a shuffle. Near copies count once in training: of the rows with the same smallest shingle hash, one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import PUNCTUATION, arrow_map, buffer_of, chunks, forget, id_type, lowered, pick, release, shingle_hashes, span_hashes, unused, word_hashes, written

#: Labelled rows in training, folds, words of each category's model, and the least share (and number) of training rows that a word is in.
SAMPLE = 12_000
FOLDS = 5
WORDS = 160
SHARE = 0.002
ROWS = 4
#: Weight of the squared coefficients against the sum of losses.
RIDGE = 0.3
#: Bytes of the beginnings of longer words that are features beside whole words.
PREFIXES = (4, 5, 6, 7)
_U = np.uint64


def default_categories() -> dict[str, Column]:
    """The chain over a table of labels: category and what it is from the label columns, in the order of prediction."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def marks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of the beginnings of longer ones, and the text of each."""
    which = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes, rows, of = [h], [which], span_hashes(raw)
    for n in PREFIXES:
        k = np.flatnonzero(ends - starts > n)
        hashes.append(of(starts[k], starts[k] + n) ^ _U(n))
        rows.append(which[k])
    return np.concatenate(hashes), np.concatenate(rows)


def dense_features(raw: np.ndarray, offsets: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: length, and shares of capitals, of other ASCII marks, and of repeated words."""
    n_bytes, n_words = np.diff(offsets), np.diff(first)
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in ((raw >= 65) & (raw <= 90), (np.frombuffer(raw.tobytes().translate(PUNCTUATION), np.uint8) == 0) & (raw > 32))]
    shares = [(s[offsets[1:]] - s[offsets[:-1]]) / np.maximum(1, n_bytes) for s in sums]
    which = np.repeat(np.arange(len(n_words)), n_words)
    order = np.lexsort((h, which))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (which[order][1:] == which[order][:-1])
    repeats = np.bincount(which[order][again], minlength=len(n_words)) / np.maximum(1, n_words)
    return np.stack([np.log1p(n_words) / 10, *(np.minimum(1, 10 * s) for s in shares), repeats], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Coefficients (the last one free of the penalty) by Newton's method with halved steps where the loss would rise."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w))

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penalty * w)
        size = 1.0
        while (after := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        done = now - after < 1e-6 * (1 + abs(now))
        w, now = (w - size * step, after) if after <= now else (w, now)
        if done:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))


@dataclass
class Chain:
    """A fitted chain: the words' hashes in ascending order, and for each category its name, coefficients and threshold."""

    words: np.ndarray
    models: list[tuple[str, np.ndarray, float]]

    def features(self, text: pa.Array) -> np.ndarray:
        out = np.zeros((len(text), len(self.words) + 4))
        h, _, _, first = word_hashes(*(plain := buffer_of(text)), PUNCTUATION)
        out[:, len(self.words) :] = dense_features(*plain, h, first)
        raw, offsets = lowered(text)
        h, starts, ends, first = word_hashes(raw, offsets, PUNCTUATION)
        if len(self.words) and len(h):
            h, rows = marks(raw, starts, ends, h, first)
            at = np.searchsorted(self.words, h).clip(max=len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == h)
            out[rows[hit], at[hit]] = 1
        return out

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, w, _ in self.models:
            full = np.hstack([x, *(p[:, None] for p in out)])
            out.append(probability(full, w))
        return out


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fits the chain on a bounded sample of the labelled rows of ``docs``. Labels that are null or contradict each other take the larger value; without labelled rows every probability is 0.

    Null or empty texts count as empty ones; rows with null ids aren't labelled; rows that repeat, or are near copies, count once. Either table may be empty; other columns don't matter.
    """
    categories = categories or default_categories()
    names, labels_of = [*categories], [f"c{i}" for i in range(len(categories))]
    largest = [F.coalesce(F.max(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(categories.values())]
    base = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("doc_id")).agg(*largest)
    some = base.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = pick(docs, id_col, text_col).join(F.broadcast(some), "doc_id")  # `sample` ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in chunks(batch, "text"):
                raw, offsets = buffer_of(part.column("text"))
                h, _, _, first = word_hashes(raw, offsets, PUNCTUATION)
                dense = dense_features(raw, offsets, h, first)
                s, bounds = shingle_hashes(h, first, 5)
                least = [int(s[a:b].min().view(np.int64)) if a < b else 0 for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                raw, offsets = lowered(part.column("text"))
                h, starts, ends, first = word_hashes(raw, offsets, PUNCTUATION)
                h, rows = marks(raw, starts, ends, h, first)
                order = np.argsort(rows, kind="stable")
                h, edges = h[order], np.searchsorted(rows[order], np.arange(part.num_rows + 1))
                words = [np.unique(h[a:b]).view(np.int64) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(part.column(c) for c in labels_of), pa.array(least, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array([x.tobytes() for x in dense], pa.binary())],
                    ["doc_id", *labels_of, "least", "words", "dense"],
                )

    schema = f"doc_id {id_type(docs, id_col)}, {', '.join(f'{c} double' for c in labels_of)}, least long, words array<long>, dense binary"
    every = written(rows.mapInArrow(run, schema).groupBy("least").agg(F.min(F.struct("doc_id", *labels_of, "words", "dense")).alias("r")).select("least", "r.*"), "toxicity-sample")
    got, key = every, F.struct(F.xxhash64("least"), "least")
    if every.count() > sample:  # an id may have any number of texts
        last = every.select(key.alias("k")).orderBy("k").limit(sample).agg(F.max("k").alias("k")).first()["k"]
        got = every.where(key <= F.struct(*(F.lit(x).cast("long") for x in last))) if last else every.where("false")
    got = got.withColumn("fold", F.pmod("least", F.lit(FOLDS)).cast("int")).drop("least")
    if not got.count():
        forget(every)
        return Chain(np.zeros(0, _U), [(n, np.append(np.zeros(4 + i), -35.0), 1.0) for i, n in enumerate(names)])
    chosen = chosen_words(got, labels_of)
    words = np.unique(np.concatenate(chosen))
    x, folds, ys = training_matrix(got, labels_of, words)
    forget(every)
    dense = np.arange(len(words), len(words) + 4)
    columns = [np.concatenate([np.searchsorted(words, c), dense]) for c in chosen]
    models, before = [], []
    for name, y in zip(names, ys, strict=True):
        apart = np.zeros(len(y))
        for k in range(FOLDS):
            inner = folds != k
            if inner.any() and not inner.all():
                full = np.hstack([x[:, columns[k]].astype(np.float64), *(p[:, None] for p in before)])
                apart[~inner] = probability(full[~inner], fit_logistic(full[inner], y[inner].astype(float)))
        full = np.hstack([x[:, columns[FOLDS]].astype(np.float64), *(p[:, None] for p in before)])
        models.append((name, fit_logistic(full, y.astype(float)), best_threshold(apart, y)))
        before.append(apart)
    return Chain(chosen[FOLDS], models)


def chosen_words(got: DataFrame, labels_of: list[str]) -> list[np.ndarray]:
    """For each fold the hashes of the words that tell the categories best by chi-square in the rows of the others, ``WORDS`` a category at most among those in enough rows; at last those of all rows."""
    sizes = got.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in labels_of)).collect()  # a row for each fold
    there = {c: [sum(r[c] for r in sizes if r["fold"] != k) for k in range(FOLDS + 1)] for c in ("n", *labels_of)}
    rows = got.select(F.explode("words").alias("w"), "fold", F.lit(1.0).alias("n"), *labels_of)
    without = [F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k in range(FOLDS + 1) for c in ("n", *labels_of)]
    counts = rows.groupBy("w").agg(*without).where(F.col(f"n_{FOLDS}") >= ROWS)
    each = []
    for k in range(FOLDS + 1):
        n, m = there["n"][k], F.col(f"n_{k}")
        for i, c in enumerate(labels_of):
            if not n:
                continue
            share = there[c][k] / n
            chi = F.pow(F.col(f"{c}_{k}") - m * share, 2) / (m * (share * (1 - share)) * (1 - m / n) + 1e-9)
            enough = m >= max(ROWS, SHARE * n)
            each.append(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.when(enough, chi).alias("chi")))
    told = counts.select("w", F.explode(F.array(*each)).alias("e")).select("w", "e.*").where("chi > 10.8")  # a chance of 1 in 1000
    best = Window.partitionBy("k", "i").orderBy(F.desc("chi"), "w")
    out: list[set[int]] = [set() for _ in range(FOLDS + 1)]
    for r in told.withColumn("r", F.row_number().over(best)).where(F.col("r") <= WORDS).select("k", "w").collect():
        out[r["k"]].add(r["w"])
    return [np.sort(np.array([*x], np.int64).view(_U)) for x in out]


def training_matrix(got: DataFrame, labels_of: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Features, folds and labels of the sample in the order of ids, on the driver: sample rows x (chosen words + 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s, dense in zip(batch.column("words"), batch.column("dense").to_pylist(), strict=True):
                x = np.zeros(len(words) + 4, np.float32)
                x[len(words) :] = np.frombuffer(dense)
                s = s.values.to_numpy(zero_copy_only=False).view(_U)
                if len(words) and len(s):
                    at = np.searchsorted(words, s).clip(max=len(words) - 1)
                    x[at[words[at] == s]] = 1
                rows.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), *(batch.column(c) for c in labels_of), pa.array(rows, pa.binary())], ["doc_id", "fold", *labels_of, "x"])

    kind = got.schema["doc_id"].dataType.simpleString()
    rows = got.mapInArrow(run, f"doc_id {kind}, fold int, {', '.join(f'{c} double' for c in labels_of)}, x binary").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["x"]])
    return x, rows["fold"].to_numpy(), [rows[c].to_numpy() > 0 for c in labels_of]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a row counts: the best F1 on out-of-fold scores, in the middle of the gap to the next score below; 0.5 where nothing is positive."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    s = p[order]
    f[:-1][s[:-1] == s[1:]] = 0  # equal scores can't be parted
    k = int(np.argmax(f))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def score_texts(df: DataFrame, chain: Chain, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``df`` with a probability column for each category, and these columns' names. Null texts count as empty."""
    names = []
    for name, _, _ in chain.models:
        names.append(unused(df, f"p_{name}"))
    columns = df.columns

    def make():
        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = chain.scores(chain.features(batch.column(text_col).fill_null("")))
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in p)], [*columns, *names])

        return part

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` double" for n in names)])
    return arrow_map(df, make, schema, text_col), names


def classify(df: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, a probability p_<category> and a boolean is_<category> for every row of ``df``.

    Null or empty texts are scored as empty; repeated rows and null ids stay. An empty table gives no rows.
    """
    chain = train_chain(df, labels, categories, sample, id_col, text_col)
    out, names = score_texts(pick(df, id_col, text_col), chain)
    return out.select("doc_id", *(F.round(n, 9).alias(n) for n in names), *((F.col(n) >= t).alias(f"is_{name}") for n, (name, _, t) in zip(names, chain.models, strict=True)))


def reject(df: DataFrame, labels: DataFrame, category: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that aren't of the category, with all columns."""
    chain = train_chain(df, labels, None, SAMPLE, id_col, text_col)
    out, names = score_texts(df, chain, text_col)
    which = [name for name, _, _ in chain.models].index(category)
    return out.where(F.col(names[which]) < chain.models[which][2]).select(*df.columns)
