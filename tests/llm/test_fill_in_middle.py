import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import fill_in_middle as M

UNITS = {"char": lambda t: list(t), "word": lambda t: re.findall(r"[^ \t-\r]+[ \t-\r]*|^[ \t-\r]+", t), "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+$", t)}


@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("a é日🎉\n\t\x00")), min_size=1, max_size=60), st.sampled_from(sorted(UNITS)))
def test_units(text, unit):
    data, want = text.encode(), UNITS[unit](text)
    mask = M.unit_ends(data, unit)
    assert mask.bit_count() == len(want)
    assert [M.end_of(mask, len(data), k) for k in range(len(want) + 1)] == [len("".join(want[:k]).encode()) for k in range(len(want) + 1)]


def plain(doc_id, text, unit="char", cut=90, spm=20):
    text, key = text or "", "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNITS[unit](text)
    n = len(units)
    if not text or any(m in text for m in M.MARKERS) or h[2] % 100 >= cut:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_edges(edge, unit):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()] + [(i, t) for i, t in enumerate(["a<P", "<P><S>", "x <M> y", "<", "<S<", "<<M"] * 20, 100)]
    df = edge.sparkSession.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, output string, n int")
    out = M.fill_in_middle(df, unit=unit)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(plain(*r, unit)) for r in rows)
    back = out.select("doc_id", M.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in rows)


def test_documents(documents):
    rows = documents.select("doc_id", "text").collect()
    assert sorted(map(tuple, M.fill_in_middle(documents).collect()), key=repr) == sorted((plain(*r) for r in rows), key=repr)


def test_all_or_none(documents):
    assert {r["form"] for r in M.fill_in_middle(documents, cut=0).select("form").distinct().collect()} == {"plain"}
    assert {r["form"] for r in M.fill_in_middle(documents, cut=100, suffix_first=100).select("form").distinct().collect()} <= {"spm", "plain"}


def test_long_text_takes_linear_time(spark):
    text = "é日a " * 2_000_000
    (row,) = M.fill_in_middle(spark.createDataFrame([(1, text)], "doc_id long, text string"), cut=100).select("n", F.sha2("output", 256).alias("h")).collect()
    assert row["n"] == 8_000_000 and row["h"] == hashlib.sha256(plain(1, text, cut=100)[5].encode()).hexdigest()


def test_markers():
    with pytest.raises(ValueError):
        M.checked_markers(["<P>", "<P>", "<M>"])
    with pytest.raises(ValueError):
        M.checked_markers(["ab", "ca", "d"])
    with pytest.raises(ValueError):
        M.unit_ends(b"a", "page")


def test_empty(empty):
    assert M.fill_in_middle(empty).collect() == []
