import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import source_audit as A
from millrace.llm._common import cleanup

WORDS = "the a of é ÉÉ naïve Straße x yy ÀÀ 日本 the's co-op İstanbul K q".split()


def plain(rows, least=3, ranks=200):
    """The audit in loops over rows, terms and pairs of sources."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(x or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for x, s, t in rows]
    seen = defaultdict(Counter)
    for lang, _, words in docs:
        seen[lang].update(set(words))
    kept = {lang: {t for t, n in seen[lang].items() if n >= least} for lang, _, _ in docs}
    count = {(lang, s): Counter() for lang, s, _ in docs}
    for lang, s, words in docs:
        count[lang, s].update(w for w in words if w in kept[lang])

    def share(counts, t, v):
        return 1 + 1_000_000_000 * (counts[t] + 1) // (sum(counts.values()) + v)

    out = []
    for (lang, s), mine in count.items():
        v, whole = len(kept[lang]), Counter()
        for (other, _), c in count.items():
            if other == lang:
                whole.update(c)
        found = {"pair": [], "term": []}
        for (other, item), c in count.items():
            if other == lang and item != s:
                found["pair"].append((item, sum((share(mine, t, v) - share(c, t, v)) ** 2 // share(c, t, v) for t in kept[lang])))
        for t in kept[lang]:
            p, q = share(mine, t, v), share(whole, t, v)
            if mine[t] and p > q:
                found["term"].append((t, (p - q) ** 2 // q))
        for part, items in found.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < ranks]
    return sorted(out)


def audited(df, **how):
    out = A.audit_sources(df, **how)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = sorted(tuple(r) for r in out.collect())
    cleanup(df.sparkSession)
    return rows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "c", "", None]), " ".join(rng.choices(WORDS, range(len(WORDS), 0, -1), k=rng.randrange(30)))) for _ in range(300)]
    made += [("fr", "a", "un deux"), ("fr", "b", ""), ("xx", "only", None), ("en", "empty", "... 12 \x00"), ("en", None, "THE thE\tThe"), ("en", "long", "word " * 20_000 + "once"), ("en", "long", "word," * 3), ("en", "a", "word")]
    return made + made[:40]


@pytest.mark.parametrize("head,block", [(A.HEAD, A.BLOCK), (5, 3), (0, 1)])
def test_equals_loops(spark, rows, head, block):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(7)
    assert audited(df, head=head, block=block) == plain(rows)


def test_few_ranks_and_other_names(spark, rows):
    df = spark.createDataFrame(rows, "l string, s string, t string")
    assert audited(df, lang_col="l", source_col="s", text_col="t", least=10, ranks=2, head=4) == plain(rows, 10, 2)


def test_many_sources(spark, monkeypatch):
    """More pairs of sources in a term's postings than a task takes up or keeps at once."""
    monkeypatch.setattr(A, "PAIRS", 50)
    monkeypatch.setattr(A, "CELLS", 100)
    rng = random.Random(3)
    rows = [("en", f"s{i % 40}", " ".join(rng.choices(WORDS, k=6))) for i in range(200)]
    assert audited(spark.createDataFrame(rows, "lang string, source string, text string")) == plain(rows)


def test_small_buffers(spark, rows, monkeypatch):
    monkeypatch.setattr(A, "ENTRIES", 3)
    assert audited(spark.createDataFrame(rows, "lang string, source string, text string"), head=6) == plain(rows)


def test_full_bitmap(spark, rows, monkeypatch):
    """A bitmap that tells nothing changes nothing."""
    monkeypatch.setattr(A, "bitmap", lambda terms: np.full(A.BITS // 8, 255, np.uint8))
    assert audited(spark.createDataFrame(rows, "lang string, source string, text string"), head=4) == plain(rows)


def test_empty(empty):
    assert audited(empty.selectExpr("text", "text as lang", "text as source")) == []
    assert audited(empty.sparkSession.createDataFrame([(None, None, None)] * 3, "lang string, source string, text string")) == []


def test_shares_of_any_size(spark):
    rows = [(n, n * 3, v) for n in (0, 1, 999_999_999, 10**9, 10**9 + 1, 10**15, 2 * 10**18) for v in (0, 1, 10**6)]
    got = spark.createDataFrame(rows, "n long, t long, v long").select("n", "t", "v", A.share(F.col("n"), F.col("t") - F.col("t") % 7, F.col("v")).alias("p")).collect()
    assert all(r["p"] == (1 + 10**9 * (r["n"] + 1) // (r["t"] - r["t"] % 7 + r["v"]) if r["v"] else 0) for r in got)


def test_matches_are_whole_words():
    finder = A.automaton([b"a", b"ab", b"b"])
    ends, which = A.matches(finder, b" a ab  b abc a ")
    assert ends.tolist() == [2, 5, 8, 14] and which.tolist() == [0, 1, 2, 0]
    bits = np.zeros(A.BITS // 8, np.uint8)
    assert A.others(b" a ab  b abc a ", ends, bits) == []
    assert A.others(b" a ab  b abc a ", ends, ~bits) == [b"abc"]
