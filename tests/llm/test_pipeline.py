"""The pipeline and the toxicity chain against plain versions of them."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

import corpus_pipeline
from millrace.llm import _common as C
from millrace.llm import toxicity as T
from millrace.llm.secret_scan import RATIO, Scanner


def marks_of(text):
    raw, offsets = C.lowered(pa.array([text]))
    h, starts, ends, first = C.word_hashes(raw, offsets, C.PUNCTUATION)
    return set(T.marks(raw, starts, ends, h, first)[0].tolist())


def dense_of(text):
    raw, offsets = C.buffer_of(pa.array([text]))
    h, _, _, first = C.word_hashes(raw, offsets, C.PUNCTUATION)
    return T.dense_features(raw, offsets, h, first)[0]


def least_of(text):
    h, _, _, first = C.word_hashes(*C.buffer_of(pa.array([text])), C.PUNCTUATION)
    s, _ = C.shingle_hashes(h, first, 5)
    return int(s.min()) if len(s) else 0


def plain_fit(x, y):
    """A penalised logistic model by Newton's method, until the gradient is gone."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.append(np.full(x.shape[1] - 1, T.RIDGE), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + penalty * w
        if np.abs(gradient).max() < 1e-9:
            break
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty) + 1e-12 * np.eye(len(w)), gradient)
        w = w - step * min(1, 5 / max(1e-9, np.abs(step).max()))
    return w


def plain_probability(x, w):
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))


def plain_chain(documents, labels):
    """Probabilities and decisions of the last category for each text, in loops over rows and words."""
    known = {}
    for d, quality, toxic in labels:
        old = known.get(d, (0, 0))
        known[d] = (max(old[0], 1 - quality), max(old[1], toxic))
    rows = {}
    for d, text in sorted(documents):
        if d in known:
            rows.setdefault(least_of(text), (d, text))
    rows = sorted(rows.values())
    n, ys = len(rows), [np.array([known[d][c] for d, _ in rows], float) for c in (0, 1)]
    sets = [marks_of(t) for _, t in rows]
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    folds = np.array([signed(least_of(t)) % T.FOLDS for _, t in rows])

    def chosen(use):
        """The words that tell the categories best in some rows."""
        out, m = set(), int(use.sum())
        for y in ys:
            every, hit = (Counter(w for s, u, v in zip(sets, use, y, strict=True) if u and (v or not only) for w in s) for only in (False, True))
            share = y[use].mean()
            chi = {w: (hit[w] - k * share) ** 2 / (k * share * (1 - share) * (1 - k / m) + 1e-9) for w, k in every.items() if k >= max(T.ROWS, T.SHARE * m)}
            out |= set(sorted((w for w in chi if chi[w] > 10.8), key=lambda w: (-chi[w], signed(w)))[: T.WORDS])
        return sorted(out)

    features = lambda words, t, s: [*(w in s for w in words), *dense_of(t)]
    words = [chosen(folds != k) for k in range(T.FOLDS + 1)]
    x = [np.array([features(w, t, s) for (_, t), s in zip(rows, sets, strict=True)], float) for w in words]
    models, before = [], []
    for y in ys:
        apart = np.zeros(n)
        for k in range(T.FOLDS):
            full = np.hstack([x[k], *(p[:, None] for p in before)])
            apart[folds == k] = plain_probability(full[folds == k], plain_fit(full[folds != k], y[folds != k]))
        cuts = sorted(set(apart.tolist()), reverse=True)
        f1 = [2 * y[apart >= c].sum() / ((apart >= c).sum() + y.sum()) for c in cuts]
        best = int(np.argmax(f1))
        full = np.hstack([x[T.FOLDS], *(p[:, None] for p in before)])
        models.append((plain_fit(full, y), (cuts[best] + cuts[best + 1]) / 2 if best + 1 < len(cuts) else cuts[best]))
        before.append(apart)
    out = {}
    for d, text in documents:
        seen = features(words[T.FOLDS], text, marks_of(text))
        for w, threshold in models:
            p = plain_probability(np.array(seen, float), w)
            seen = [*seen, p]
        out[d] = (p, p >= threshold)
    return out


@pytest.fixture(scope="module")
def tables(spark, sf, documents):
    docs = [(r["doc_id"], r["text"] or "") for r in documents.collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    return docs, labels, bench


def test_op6_against_plain_chain(spark, sf, documents, tables):
    docs, labels, _ = tables
    want = plain_chain(docs, labels)
    got = {r["doc_id"]: r for r in T.classify(documents, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert len(got) == len(want) and any(v[1] for v in want.values())
    assert max(abs(got[d]["p_toxic"] - p) for d, (p, _) in want.items()) < 0.02
    assert {d for d in got if got[d]["is_toxic"]} == {d for d in want if want[d][1]}


def near_groups(docs):
    """The smallest id of each document's group: five-word shingles, similarity of 0.8 or more, all pairs."""
    sets = {}
    for d, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = {d: min(x, y) if g in (x, y) else g for d, g in group.items()}
    return group


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def holds(text, item):
    """Whether any stretch of a quarter more than the item's words has enough of it, or of it and its answer."""
    w, x = words_of(text), words_of(item)
    sentences = [s for s in re.split(r"(?<=[.?!])\s+", item) if s.strip()]
    answer = set(words_of(sentences[-1])) if len(sentences) > 1 else set(x)
    counts = Counter(x)
    for i in range(len(w)):
        some = w[i : i + len(x) + len(x) // 4]
        if w[i] in counts and sum((Counter(some) & counts).values()) >= 0.6 * len(x):
            share = common(x, some) / len(x)
            if share >= 0.7 or share >= 0.6 and len(answer & set(some)) >= 0.8 * len(answer):
                return True
    return False


def test_pipeline_against_plain_stages(spark, sf, documents, tables):
    from tokenizers import Tokenizer

    docs, labels, bench = tables
    toxic = plain_chain(docs, labels)
    docs = [(d, t) for d, t in docs if not toxic[d][1]]
    group = near_groups(docs)
    docs = [(d, t) for d, t in docs if group[d] == d]
    docs = [(d, t) for d, t in docs if not any(holds(t, item) for _, item in bench)]
    scanner, library = Scanner(P.path("byte_bpe_50k.tiktoken"), RATIO), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = set()
    for d, text in docs:
        out, at = "", 0
        for _, a, b in scanner.spans(text):
            out += text[at:a] + "<secret>" if a >= at else ""
            at = max(at, b)
        ids = library.encode(out + text[at:], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    C.cleanup(spark)
    got = corpus_pipeline.run(spark, sf)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) < documents.count()
    assert len([t for t in C._tables if "pipeline-" in t]) == 1  # the one that the result reads
    C.cleanup(spark)
    assert not C._tables


def test_stages_take_documents_without_n_chars(spark, sf, documents):
    some = documents.drop("n_chars").withColumnRenamed("lang", "other")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, some, sf)
        assert out.columns == some.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, some.limit(3), sf).count() == 3
