import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate as D
from millrace.llm import toxicity as T
from millrace.llm.queries import QUERIES


def corpus(spark, n=600):
    """Documents of random words; a fifth have one of three bad words, and some of these are in capitals or in other scripts."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(400)])
    bad = ["scumbag", "ÉNERVÉ", "Trottel"]
    docs, labels = [], []
    for i in range(n):
        t = list(rng.choice(words, 40))
        toxic = i % 5 == 0
        if toxic:
            t[7] = bad[i // 5 % 3] if i % 2 else bad[i // 5 % 3].lower()
        docs.append((i, " ".join(t)))
        if i < n // 2:
            labels.append((i, int(i % 7 != 0), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_on_unseen_rows(spark):
    docs, labels = corpus(spark)
    got = T.classify(docs, labels).toPandas()
    assert len(got) == 600 and {"p_low_quality", "p_toxic", "is_toxic"} <= set(got.columns)
    unseen = got[got.doc_id >= 300]
    assert (unseen.is_toxic == (unseen.doc_id % 5 == 0)).mean() > 0.97
    kept = T.reject(docs.withColumn("p_toxic", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "p_toxic"] and set(got[~got.is_toxic].doc_id) == {r["doc_id"] for r in kept.collect()}


def test_later_models_see_earlier_ones(spark):
    docs, labels = corpus(spark, 200)
    chain = T.train_chain(docs, labels)
    assert [len(w) for _, w, _ in chain.models] == [len(chain.words) + 5, len(chain.words) + 6]
    same = {"a": F.col("toxic"), "b": F.col("toxic")}
    first, second = T.train_chain(docs, labels, same).models
    assert second[1][-2] > 0  # the second leans on the first's probability


def test_training_rows_are_bounded(spark, monkeypatch):
    """An id may have any number of texts; training takes no more rows than it says."""
    docs = spark.range(400).selectExpr("1L as doc_id", "concat('some words and a number ', id) as text")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    matrix = T.training_matrix
    monkeypatch.setattr(T, "training_matrix", lambda *a: seen.append(matrix(*a)) or seen[-1])
    assert T.classify(docs, labels, sample=10).count() == 400 and len(seen[0][0]) == 10
    assert T.classify(docs, labels, sample=400).count() == 400 and 10 < len(seen[1][0]) <= 400


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert T.classify(edge, labels).count() == 10 and T.classify(empty, labels).count() == 0
    none = T.classify(edge, labels.where("false")).toPandas()
    assert len(none) == 10 and not none.is_toxic.any()
    assert T.reject(edge, labels.where("false")).columns == edge.columns


def test_logistic_against_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x @ [1, -2, 0, 0.5] + rng.normal(size=300) > 0).astype(float)
    w = T.fit_logistic(x, y, 1.0)
    p = T.probability(x, w)
    assert np.abs(x.T @ (p - y) + w[:-1]).max() < 1e-2 and abs((p - y).sum()) < 1e-2
    assert T.best_threshold(np.array([0.9, 0.8, 0.3, 0.2]), np.array([True, True, False, False])) == pytest.approx(0.55)
    assert T.best_threshold(np.array([0.1]), np.array([False])) == 0.5


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=20), st.lists(st.integers(0, 8), max_size=30))
def test_common_subsequence(a, b):
    masks = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    assert D.common_subsequence(masks, len(a), b) == lcs(a, b)


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_op10_against_brute_force(spark, sf, documents):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_decontaminate"](spark, sf).collect()}
    items = {r["item_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole, near = set(), set()
    for r in documents.collect():
        w = words_of(r["text"])
        for k, x in items.items():
            if len(set(x) & set(w)) < 0.4 * len(set(x)):
                continue
            if f" {' '.join(x)} " in f" {' '.join(w)} ":
                whole.add((r["doc_id"], k))
            if max((lcs(x, w[i : i + len(x) * 5 // 4]) for i in range(0, len(w), 4)), default=0) >= 0.5 * len(x):
                near.add((r["doc_id"], k))
    assert whole and whole <= got <= near


def test_recall_on_planted_passages(spark, documents):
    """Whole, edited and shortened passages in the midst of other text, against which documents must be found."""
    rng = np.random.default_rng(5)
    items = [(i, " ".join(rng.choice([f"term{k}" for k in range(3000)], 30)) + ". " + " ".join(rng.choice([f"term{k}" for k in range(3000)], 6)) + ".") for i in range(30)]
    clean = [r["text"] for r in documents.limit(60).collect()]
    rows = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        edited = [x if (k + i) % 6 else "zzz" for k, x in enumerate(w)]  # a sixth is replaced
        for j, t in enumerate((w, edited)):
            around = clean[(2 * i + j) % len(clean)].split()
            at = (37 * i) % max(1, len(around))
            rows.append((1000 * j + i, " ".join(around[:at] + t + around[at:]).upper()))
    rows += [(5000 + i, t) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(1000 * j + i, i) for i in range(30) for j in (0, 1)}
    assert got <= want and len(want - got) <= 1
    kept = D.drop_leaks(docs.withColumn("leak", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "leak"] and {5000 + i for i in range(len(clean))} <= {r["doc_id"] for r in kept.collect()} and kept.count() == len(rows) - len({d for d, _ in got})


def test_long_and_short_items(spark):
    """Word for word and with a fifth of the words replaced, in the midst of other words; short items only word for word."""
    rng = np.random.default_rng(3)
    names = np.array([f"term{k}" for k in range(9000)])
    items = {n: rng.choice(names, n).tolist() for n in (1, 3, 7, 8, 500, 600, 700, 1500, 2500, 3500, 6000)}
    noise = [f"noise{k}" for k in range(700)]
    rows, want = [], set()
    for k, (n, words) in enumerate(items.items()):
        words = words if n > 1 else ["unheardof"]
        items[n] = words
        edited = [w if i % 5 else "zzz" for i, w in enumerate(words)]
        rows += [(10 * k, noise[: 37 * k] + words + noise), (10 * k + 1, noise[: 11 * k] + edited + noise), (10 * k + 2, words[: n // 2] + noise + words[n // 2 :] if 1 < n < 8 else noise)]
        want |= {(10 * k, n)} | ({(10 * k + 1, n)} if n > 7 else set())
    rows.append((900, items[3][:2]))
    rows.append((901, items[3][2:]))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id int, text string").coalesce(1)
    bench = [(n, " ".join(w)) for n, w in items.items()]
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, spark.createDataFrame(bench, "item_id int, text string")).collect()}
    # the item of 8 words may keep under 0.7 of them, and the items of one and three words may stand in long ones
    assert want - got <= {(31, 8)} and {(d, n) for d, n in got - want if n > 8} == set() and not {d for d, n in got if n == 7} - {20}
    only = {(r["doc_id"], r["item_id"], r["cosine"]) for r in D.find_leaks(docs, spark.createDataFrame(bench[:2], "item_id int, text string")).collect()}
    assert only == {(0, 1, 1.0), (10, 3, 1.0)}


def test_a_stretch_with_the_answer_counts():
    """One stretch has 0.65 of the item without its answer, a later one 0.625 with all of it: the item is there. Against all stretches."""
    words = [*range(1, 41)]
    masks, answer_words = D.masks_of(words), set(words[32:])
    other = [0] * 100
    text = words[:26] + other + words[:17] + words[32:] + other
    assert D.best_stretch(masks, answer_words, 40, text) == (0.625, 1.0) and D.leaks(0.625, 1.0) and not D.leaks(0.65, 0.0)
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = [w if rng.random() < 0.68 else 0 for _ in range(3) for w in words + other[: rng.integers(30)]]
        every = []
        for p in (i for i, w in enumerate(text) if w):
            some = text[p : p + 50]
            share, answer = D.common_subsequence(masks, 40, some) / 40, len(answer_words & set(some)) / 8
            if share >= D.PARAPHRASE:
                every.append((D.leaks(share, answer), share, answer))
        assert D.best_stretch(masks, answer_words, 40, text) == max(every, default=(False, 0.0, 0.0))[1:]


def test_items_in_parts(spark, sf, documents, monkeypatch):
    """More items than go into a pass: the same rows, and the same documents stay."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want, kept = sorted(D.find_leaks(documents, bench).collect()), sorted(D.drop_leaks(documents, bench).collect())
    monkeypatch.setattr(D, "MOST_ITEMS", -(-bench.count() // 3))
    again = D.find_leaks(documents, bench)
    assert again.dtypes == D.find_leaks(documents, bench.limit(1)).dtypes and sorted(again.collect()) == want
    assert sorted(D.drop_leaks(documents, bench).collect()) == kept and len(kept) == documents.count() - len({r["doc_id"] for r in want})


def test_rows_of_one_id_stand_for_themselves(spark):
    words = " ".join(f"word{i}" for i in range(20))
    df = spark.createDataFrame([(5, "alpha beta gamma delta"), (5, words), (None, words), (None, "clean"), (5, None)], "doc_id int, text string")
    kept = D.drop_leaks(df, spark.createDataFrame([(1, words)], "item_id int, text string"))
    assert kept.dtypes == df.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, [r for r in df.collect() if r["text"] != words]))


def test_the_index_of_rare_words_loses_nothing(spark, documents):
    """Stretches that pass the checks and hold a passage of the least cosine are found, whatever the index says: all places of all texts against all items."""
    import pyarrow as pa

    from millrace.llm._common import PUNCTUATION, lowered, word_hashes

    rng = np.random.default_rng(9)
    vocabulary = np.array([f"t{k}" for k in range(400)])
    texts = [" ".join(rng.choice(vocabulary, 150)) for _ in range(40)]
    items = []
    for i in range(25):
        at = rng.integers(0, 100)
        w = texts[i].split()[at : at + 40]
        items.append((i, " ".join(x if rng.random() > 0.33 else str(rng.choice(vocabulary)) for x in w)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    index = next(D.indexes(docs, spark.createDataFrame(items, "item_id long, text string"), "item_id", "text"))
    h, _, _, first = word_hashes(*lowered(pa.array(texts)), PUNCTUATION)
    got = {(d, i) for d, i, *_ in D.find(index, h, first)}
    want = set()
    for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        for i, x in enumerate(index.items):
            words = x.words.tolist()
            if D.leaks(*D.best_stretch(D.masks_of(words), set(x.answer.tolist()), len(words), h[a:b].tolist())) and D.best_cosine(index.vectors, D.terms(h[a:b]), index.folded[i], len(words)) >= D.COSINE:
                want.add((d, i))
    assert want <= got and 3 <= len(want) < 25


def test_leak_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "x"), (4, "the quick brown fox jumps over the lazy dog"), (5, "too short")], "item_id int, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(edge, bench).collect())
    assert got == [(1, 1), (1, 4), (5, 1), (5, 1), (5, 4), (5, 4)]
    assert D.find_leaks(empty, bench).count() == 0 and D.find_leaks(edge, bench.where("false")).count() == 0
    assert D.drop_leaks(edge, bench).count() == 7 and D.drop_leaks(empty, bench).count() == 0


def test_pipeline(spark, sf, documents):
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf)
        assert docs.dtypes == documents.dtypes, name
        docs = corpus_pipeline.written(docs, "test")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        sizes.append(len(ids))
    assert documents.count() > sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert not docs.where(F.col("text").rlike("token = \"[0-9a-f]{40}")).count() and docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[0] == "doc_id" and {r["doc_id"] for r in out.select("doc_id").collect()} == ids and len(corpus_pipeline.STAGES) == 5
