import math
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lm_scoring as L
from millrace.llm._common import cleanup, vocabulary

PATH = vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encode():
    return L.ids(PATH)


@pytest.fixture(scope="module")
def model(documents, encode):
    docs = documents.selectExpr("doc_id", "coalesce(text, '') as text", "false as held_out", "monotonically_increasing_id() as row")
    base = L.base_of(L.word_counts(docs), docs.count(), L.HEAD)
    table = L.written(L.encoded(docs, base, PATH, "long"), "lm-test").cache()
    out = L.model_of(table, encode.end, encode.dtype)
    table.unpersist()
    cleanup(documents.sparkSession)
    return out


def plain_base(rows, fold=1, folds=5):
    """The base in loops."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % folds == fold, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for i, t in rows]
    seen = Counter(w for _, held, words in docs if not held for w in words)
    n, v = sum(seen.values()), len(seen)
    return sorted(((i, held, len(words), sum(w in seen for w in words), n, round(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 6)) for i, held, words in docs), key=repr)


def scored(df, **how):
    out = L.score_texts(df, **how)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = out.collect()
    cleanup(df.sparkSession)
    return rows


def bases(rows):
    return sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in rows), key=repr)


@pytest.mark.parametrize("head", [L.HEAD, 3, 0])
def test_base_equals_loops(edge, head):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = scored(edge, head=head)
    assert bases(got) == plain_base(rows)
    by = {}
    for r in got:  # rows of one id and text have one score
        by.setdefault((r["doc_id"], r["n_tokens"]), set()).add(round(r["score"], 6))
        assert r["score"] < 0
    assert all(len(x) == 1 for x in by.values())


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert bases(scored(documents)) == plain_base(rows)


def test_no_training_documents(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = [(i, "a b A") for i in held]
    got = scored(spark.createDataFrame(rows, "doc_id long, text string"))
    assert bases(got) == plain_base(rows) and all(math.isfinite(r["score"]) for r in got)


def test_empty(empty):
    assert scored(empty) == []


def plain_log_probability(m, ids, end):
    """The model's log-probability of a text's ids in loops over its tokens: attention by a plain softmax over what the token's window lets it see."""
    w, total = m.w, 0.0
    inputs = [end] * (L.CONTEXT + 1) + [int(i) for i in ids]
    for t, y in enumerate(ids):
        at = L.CONTEXT + t
        keys = range(t // L.STRIDE * L.STRIDE, at + 1)
        x = {j: w["embedding"][m.units[inputs[j]]].astype(float) for j in keys}
        q = x[at] @ w["query"]
        s = np.array([q @ (x[j] @ w["key"]) + w["distance"][at - j] for j in keys])
        p = np.exp(s - s.max())
        seen = (p / p.sum()) @ np.array([x[j] @ w["value"] for j in keys])
        h = np.maximum(x[at] @ w["own"] + seen @ w["seen"] + w["hidden"], 0)
        for u, sign in zip(m.tree.path[y], m.tree.sign[y], strict=True):
            if sign:
                z = m.direct[m.units[inputs[at]], u] + (h @ w["unit"][:, u] + w["bias"][u] if u < w["unit"].shape[1] else 0)
                total -= math.log1p(math.exp(-sign * z))
        total += m.tree.below[y]
    return total


def test_scores_equal_loops(documents, model, encode, monkeypatch):
    monkeypatch.setattr(L, "ROW_TOKENS", 64)  # texts lie in several rows
    docs = documents.orderBy("doc_id").limit(6).selectExpr("doc_id", "substring(text, 1, 900) as text", "false as held_out", "doc_id as row").unionByName(documents.sparkSession.createDataFrame([(-1, "", False, -1)], "doc_id long, text string, held_out boolean, row long"))
    base = L.base_of(L.word_counts(docs), 7, 10)
    table = L.encoded(docs, base, PATH, "long")
    got = {r["row"]: r["score"] for r in L.row_scores(table, model, encode.end, encode.dtype).groupBy("row").sum("score").withColumnRenamed("sum(score)", "score").collect()}
    want = {r["row"]: plain_log_probability(model, [*encode.of(r["text"]), encode.end], encode.end) / math.log(10) for r in docs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 * max(1, abs(want[k])) for k in want)


def test_probabilities_add_up(model, encode):
    """After any context, the probabilities of all ids are 1 together."""
    rng = np.random.default_rng(5)
    before, after = rng.integers(0, len(model.direct), (2, 1, L.STRIDE))
    n = encode.end + 1
    z = model.forward(before, after)["z"][3:4]
    odds = model.odds(np.repeat(z, n, axis=0), np.repeat(after.ravel()[3:4], n), np.arange(n))
    p = np.exp(model.lower(np.repeat(after.ravel()[3:4], n), np.arange(n)) - np.log1p(odds.astype(float)).sum(axis=1))
    assert abs(p.sum() - 1) < 1e-4


def test_tree():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 1000, 300) ** 2
    for nodes in (1, 7, 299, 1000):
        t = L.huffman(counts, nodes)
        total = np.log((counts + 1) / (counts + 1).sum())
        share = np.where(t.sign > 0, t.first[np.minimum(t.path, len(t.first) - 1)], 1 - t.first[np.minimum(t.path, len(t.first) - 1)])
        assert np.allclose(np.where(t.sign == 0, 0, np.log(share)).sum(axis=1) + t.below, total)
        # without pairs the direct path is that of the counts alone
        assert np.allclose(L.direct_path(np.zeros((2, t.subtree.max() + 1)), t)[0], np.log(t.first / (1 - t.first)), atol=1e-4)


def test_gradients(model):
    """Against differences of the loss."""
    rng = np.random.default_rng(1)
    w = {k: (x + 0.05 * rng.standard_normal(x.shape)).astype(np.float32) for k, x in model.w.items()}
    m = L.Model(w, model.tree, model.units, model.direct)
    before, after = rng.integers(0, len(m.direct), (2, 8, L.STRIDE))
    nexts = rng.choice(np.argsort(model.tree.below)[-500:], (8, L.STRIDE))
    nexts[-1, 5:] = -1
    loss, g = m.gradients(before, after, nexts)
    assert abs(loss + m.log_probabilities(before, after, nexts).sum() / (nexts >= 0).sum()) < 1e-3
    for k, x in w.items():
        d = rng.standard_normal(x.shape).astype(np.float32)
        d /= np.sqrt((d * d).sum())
        got = []
        for step in (0.02, -0.02):
            x += np.float32(step) * d
            m.tables()
            got.append(-m.log_probabilities(before, after, nexts).sum() / (nexts >= 0).sum())
            x -= np.float32(step) * d
        assert abs((got[0] - got[1]) / 0.04 - (g[k] * d).sum()) < 2e-3 + 0.05 * abs((g[k] * d).sum()), k


def test_windows():
    row = np.arange(100, 150)
    inputs, nexts = L.windows(row, 0, 7)
    assert inputs.ravel()[: L.CONTEXT + 1].tolist() == [7] * 17 and inputs.ravel()[17:66].tolist() == list(range(100, 149)) and nexts.ravel()[:50].tolist() == row.tolist() and (nexts.ravel()[50:] == -1).all()
    later, more = L.windows(np.arange(100 + 32 - 17, 150), 17, 7)
    assert (later == inputs[2:]).all() and (more == nexts[2:]).all()


def test_held_out_texts_gain_from_training(spark):
    """Texts with order: the model learns more than counts, and what it learned holds for texts that it hasn't seen."""
    rng = np.random.default_rng(4)
    names = ["red", "green", "blue", "black", "white", "small", "large", "old", "new", "fine"]
    rows = []
    for i in range(600):
        at, words = int(rng.integers(10)), []
        for _ in range(60):
            words.append(names[at])
            at = (at + (1 if rng.random() < 0.9 else int(rng.integers(10)))) % 10
        rows.append((i, " ".join(words)))
    held = [r for r in scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)) if r["held_out"]]
    assert len(held) > 50 and sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)


def test_every_window_is_trained_on(spark, model, encode):
    """Each id of a training document moves its embedding, in whichever window and row of the table it stands; a round takes the documents that the other one doesn't."""
    own = np.flatnonzero(model.units < L.OWN)
    text = own[own != encode.end][:900].astype(encode.dtype)
    stretches = [(0, text[:400]), (17, text[400 - 17 :])]
    rounds = {r["first"]: r["id"] for r in spark.range(64).selectExpr("id", f"pmod(xxhash64(id), {L.FIRST}) = 0 as first").collect()}  # a document of each round
    rows = [(r, False, bytearray(part.tobytes()), skip) for r in rounds.values() for skip, part in stretches]
    table = spark.createDataFrame(rows, "row long, held_out boolean, ids binary, skip long").coalesce(1)
    for round_ in (0, 1):
        got = L.trained(table, model, encode.end, encode.dtype, round_)
        moved = (np.abs(got.w["embedding"] - model.w["embedding"]) > 1e-3).any(axis=1)  # beyond rounding
        assert moved[model.units[text[:-1]]].all()  # no id comes after the last one


def test_long_texts_are_encoded_in_parts(encode, monkeypatch):
    """Cuts before white space change no id, wherever they fall."""
    texts = [" a  b\n\n c d'll x\u00a0y \u2003 z  ", "x" * 90, " " * 90, "\u65e5\u672c \u8a9e\t\t1 22  333 !?\r\n" * 7, "", "a", "don't  \x1c\x85 stop " * 9]
    for part in (1, 2, 7, 50):
        monkeypatch.setattr(L, "PART", part)
        for t in texts:
            assert encode.of(t).tolist() == encode.encoding.encode_ordinary(t)


def test_lines_equal_windows(model):
    """A line's log-probability is that of its window with the line before, over the edge of a block of lines too."""
    rng = np.random.default_rng(3)
    lines = rng.integers(0, len(model.direct), (2 * L.STEP + 20, L.STRIDE))
    nexts = rng.choice(np.argsort(model.tree.below)[-500:], (len(lines) - 1, L.STRIDE))
    nexts[::5, 3:] = -1
    want = model.log_probabilities(lines[:-1], lines[1:], nexts).reshape(-1, L.STRIDE).sum(axis=1)
    assert np.allclose(model.line_logs(lines, nexts), want, atol=1e-3) and (nexts[0, :3] >= 0).all()


STEPS = """
import resource
import numpy as np
from millrace.llm import lm_scoring as L
from millrace.llm._common import keep_freed

rng = np.random.default_rng(1)
tree = L.huffman(rng.integers(0, 1000, 3000) ** 2, L.NODES)
direct = np.zeros((L.OWN + L.SHARED, len(tree.first)), np.float32)
m = L.Model(L.first_parameters(len(direct), tree.upper()), tree, np.arange(3000) % len(direct), direct)
lines, nexts = rng.integers(0, len(direct), (L.STEP + 1, L.STRIDE)), rng.integers(0, 3000, (L.STEP, L.STRIDE))
keep_freed()
for k in range(30):
    if k == 10:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    m.tables()
    m.descent(lines, nexts, nexts.size)
    m.line_logs(lines, nexts)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 20)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="mallopt is glibc's")
def test_steps_use_their_memory_again():
    """A step of training and one of scoring take few new pages from the system: these were a third of the work (1,300 pages a step)."""
    pages = float(subprocess.run([sys.executable, "-c", STEPS], capture_output=True, text=True, check=True, timeout=120).stdout)
    assert pages < 100
