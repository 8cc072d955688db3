import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import ngram_join
from millrace.llm.ngram_join import components, keep_one, ngram_components, overlap, prefix
from millrace.llm.queries import ORACLE_SQL, QUERIES


def sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def brute(rows, width, percent):
    """Rows (doc_id, n_shingles, component_id) by comparing all pairs."""
    s, up = sets([t for _, t in rows], width), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(((d, len(s[i]), d if not s[i] else ids.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def got(df, width, percent):
    return sorted((tuple(r) for r in ngram_components(df, width=width, percent=percent).collect()), key=repr)


@pytest.mark.parametrize("width, percent", [(4, 85), (2, 60)])
def test_against_all_pairs(documents, width, percent):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got(documents, width, percent) == brute(rows, width, percent)


def near_copies(n, words=60):
    """A chain-like group: every copy has other edits of a common text, so that some pairs link and others don't; and copies of those."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        for k in range(i % 4):
            t[(7 * i + 13 * k) % words] = f"e{i % 11}x{k}"
        out.append((1000 - i, " ".join(t)))
    return out + [(2000 + i, out[i % 5][1].upper()) for i in range(20)]


@pytest.mark.parametrize("constants", [{"SHORT": 32}, {"SHORT": 2, "CELL": 7, "MEET": 3, "FETCHED": 0}, {"SHORT": 32, "HOT": 10, "CELL": 5, "MEET": 4}, {"KEY_BITS": 6, "SHORT": 4}])
def test_groups_of_near_copies(spark, monkeypatch, constants):
    """Also where lists are hot, cut and joined on their parts, where sets are fetched by a join, and where classes share names."""
    for name, value in constants.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(60) + [(9, "alone in the world and far from all others")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width, percent in ((4, 85), (3, 70)) if len(constants) == 1 else ((4, 85),):
        assert got(df, width, percent) == brute(rows, width, percent)


def test_edges(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert got(edge, 4, 85) == brute(rows, 4, 85) and got(empty, 4, 85) == []
    kept = keep_one(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 8]
    assert keep_one(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (205, 203), (203, 201), (201, 205)]
    df = spark.createDataFrame(chain, "a long, b long").repartition(7)
    roots = {r["node"]: r["root"] for r in components(df).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, 101: 100, 203: 201, 205: 201}
    assert components(df.where("false")).count() == 0


def test_bounds():
    for n in range(1, 60):
        for m in range(n, 80):
            for t in (80, 85):
                least = next(o for o in range(m + 1) if 100 * o >= t * (n + m - o))
                assert overlap(n, m, t) == least
        assert prefix(n, 85) == n - next(o for o in range(n + 1) if 100 * o >= 85 * n) + 1


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.register("documents", spark.read.parquet(f"{sf}/documents.parquet").toPandas())
    want = con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({ORACLE_SQL['op7_ngram_join']})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in QUERIES["op7_ngram_join"](spark, sf).select("doc_id", "n_shingles", "component_id").collect())


def test_repeated_ids_keep_their_own_sets(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z")], "doc_id long, text string").withColumn("key", F.lit(1))
    assert got(df, 4, 85) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_keep_one_tells_rows_by_id_and_text(spark):
    """Rows of one id with several texts, copies of one id, copies without ids; the row that stays is the first by id."""
    texts = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcdef"}
    rows = [(2, "b"), (5, "a"), (5, "b"), (1, "c"), (1, "c"), (None, "d"), (None, "d"), (None, "b"), (7, "e"), (None, "e"), (9, "f")]
    df = spark.createDataFrame([(i, texts[k], j % 2, {"x": 1}) for j, (i, k) in enumerate(rows)], "doc_id int, text string, other int, m map<string,int>").repartition(3)
    for table in (df, df.drop("m")):
        kept = keep_one(table)
        assert kept.columns == table.columns
        assert sorted(((r["doc_id"] or -1, r["text"][0]) for r in kept.collect())) == [(-1, "d"), (1, "c"), (2, "b"), (5, "a"), (7, "e"), (9, "f")]


def test_classes_without_ids_link(spark):
    """Near copies of a text whose rows all lack an id are linked through it."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(["x", *base[1:]]), " ".join([*base[:-1], "y"]), " ".join(["x", *base[1:-1], "y"])]
    rows = [(None, texts[0]), (None, texts[0]), (4, texts[1]), (3, texts[2]), (8, "far from the others")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 4, 90) == brute(rows, 4, 90) and brute(rows, 4, 90)[0][2] == 3


def test_small_sketch_keeps_few_postings(spark, sf, documents, monkeypatch):
    """A count sketch of so few buckets that all are full doesn't call every list hot: what round one puts out stays small, and results whole."""
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    put = []
    first = ngram_join.first_round
    monkeypatch.setattr(ngram_join, "first_round", lambda posted, percent: put.append(first(posted, percent)) or put[-1])
    want = got(documents, 4, 85)
    monkeypatch.setattr(ngram_join, "HOT", 40)
    again = got(documents, 4, 85)
    sizes = [p.where("place is not null").count() for p in put]
    assert want == again == brute(rows, 4, 85) and sizes[1] <= 1.5 * sizes[0] + 1000


def test_scale_of_counts():
    import numpy as np

    counts = np.array([10**7 + int(3e3 * x) for x in np.random.default_rng(0).standard_normal(4095)] + [10**7 + 300_000])
    scale = ngram_join.scale_of(counts)
    assert scale[-1] > ngram_join.hot_scale(ngram_join.HOT) >= scale[:-1].max()  # a list of 300,000 stands out over buckets of ten millions
    assert (np.diff(ngram_join.scale_of(np.sort(counts)).astype(int)) >= 0).all()
