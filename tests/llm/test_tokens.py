import base64
import hashlib
import zlib
from types import SimpleNamespace as Plain

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm._common import shared_root, written
from millrace.llm.bpe import BytePairs, Memo, bpe_decode, bpe_encode, bpe_round_trip
from millrace.llm.queries import QUERIES
from millrace.llm.token_counts import Lengths, context_totals, length_histogram, quantiles, totals_at
from millrace.llm.token_files import Words, pack, shard_bytes, shard_read, token_files, tokenized, unpack, write_token_files

OWN = BytePairs(P.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
WORDS = Words(P.path("word_bpe_49k.json"))
TEXTS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.,!aeiotsn<|>0123ÉßΣς\x1c\x85　́")), max_size=60)


def ids(library, text, dtype="<u4"):
    return np.array(library.encode(text, add_special_tokens=False).ids, dtype).tobytes()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_bpe_is_the_library_s(text):
    assert OWN.encode(text) == ids(LIBRARY, text)
    assert OWN.decode(OWN.encode(text)) == LIBRARY.decode(LIBRARY.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_words_are_the_library_s(text):
    assert WORDS.encode(text) == ids(WORDS.tokenizer, text, WORDS.dtype)


#: Letters that the normalizer turns into a letter and a mark that isn't one, and what else composes or case-folds oddly.
ODD = "İıſẞǅﬁ\u0958\u095f\u09dc\u09df\u0a33\u0a5e\u0b5c\u0f43\ufb1d\ufb4e\u0301\u0307\u093c\u09bc\u1100\u1161\u11a8\u0915\u09a1\u05e9\u212a\u2126"


@settings(max_examples=600, deadline=None)
@given(st.text(st.one_of(st.sampled_from(ODD), st.sampled_from("ab.,.,' 1é"), st.characters(categories=["Lu", "Lt", "Lo", "Mn", "Mc"])), max_size=12))
def test_words_with_composed_letters(text):
    assert WORDS.encode(text) == ids(WORDS.tokenizer, text, WORDS.dtype)


@pytest.mark.parametrize("before", ["", "ab"])
def test_marks_after_every_code_point(before):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isalpha() or c % 64 == 0)]
    for mark in ".,":
        texts = [before + c + mark for c in letters]
        want = WORDS.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert not [t for t, w in zip(texts, want, strict=True) if WORDS.encode(t) != np.array(w.ids, WORDS.dtype).tobytes()]


def test_special_tokens_and_long_words():
    for text in ("a<|endoftext|>b <|endoftext|>", "  x   y  ", "don't I'LL", "ab" * 3000, "é" * 500):
        assert OWN.encode(text) == ids(LIBRARY, text) and WORDS.encode(text) == ids(WORDS.tokenizer, text, WORDS.dtype)


def test_segment_tree_against_plain_merging():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 5, 17, 64):
        seq = [OWN.first[b] for b in rng.choice(list(b"theinra "), n)]
        plain = list(seq)
        while True:
            ranks = [(r, i) for i in range(len(plain) - 1) if (r := OWN.rank.get(plain[i] << 32 | plain[i + 1])) is not None]
            if not ranks:
                break
            r, i = min(ranks)
            plain[i : i + 2] = [OWN.made[r]]
        assert OWN.merge(list(seq)) == plain


def test_broken_bytes_decode_to_replacements():
    half = np.array([OWN.first[0xE6], OWN.first[65]], "<u4").tobytes()
    assert OWN.decode(half) == "�A"


def test_memo_keeps_what_is_asked_again():
    made = []
    m = Memo(lambda k: made.append(k) or k, 3)
    for k in (1, 2, 3, 1, 4, 1, 5, 1):
        assert m[k] == k
    assert made.count(1) == 1 and len(m) <= 4


def test_bpe_edges(edge, empty):
    out = bpe_decode(bpe_encode(edge)).toPandas()
    texts = edge.select("doc_id", "text").toPandas()
    assert sorted(out.decoded) == sorted(t or "" for t in texts.text) and out.columns.tolist() == ["doc_id", "n_tokens", "ids", "decoded"]
    assert (out.ids.map(len) == 4 * out.n_tokens).all() and out.doc_id.isna().sum() == 1
    assert bpe_decode(bpe_encode(empty)).count() == bpe_round_trip(empty).count() == 0
    assert sorted(map(repr, bpe_round_trip(edge).collect())) == sorted(map(repr, bpe_decode(bpe_encode(edge)).collect()))


def test_op2(spark, sf, documents):
    got = QUERIES["op2_bpe"](spark, sf).toPandas().set_index("doc_id")
    for r in documents.collect():
        e = LIBRARY.encode(r["text"], add_special_tokens=False).ids
        row = got.loc[r["doc_id"]]
        assert row.n_tokens == len(e) and row.ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(e, skip_special_tokens=False).encode()).hexdigest()


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_lengths(text):
    test_lengths.of = getattr(test_lengths, "of", None) or (Lengths(P.path("byte_bpe_50k.tiktoken")), encoding())
    own, library = test_lengths.of
    assert own.of(text) == len(library.encode_ordinary(text))


def test_op3(spark, sf, documents):
    n = np.array([len(x) for x in encoding().encode_ordinary_batch([r["text"] for r in documents.collect()])])
    got = QUERIES["op3_token_counts"](spark, sf).toPandas()
    assert sorted(got.context_limit) == sorted(set(n.tolist()))
    for r in got.itertuples():
        k = r.context_limit
        assert (r.n_docs, r.docs_over, r.docs_fit, r.tokens_over) == ((n == k).sum(), (n > k).sum(), (n <= k).sum(), n[n > k].sum())
        assert r.tokens_truncated == np.minimum(n, k).sum() and r.tokens_lost == n.sum() - r.tokens_truncated and abs(r.share - (n <= k).mean()) < 1e-8
    h = length_histogram(documents)
    for r in totals_at(h, [0, 100, 10**6]).collect():
        assert r["tokens_truncated"] == np.minimum(n, r["context_limit"]).sum()
    for r in quantiles(context_totals(h), [0.5, 0.9]).collect():
        assert r["context_limit"] == np.sort(n)[int(np.ceil(r["share"] * len(n))) - 1]


def test_counts_edges(edge, empty):
    h = {r["n_tokens"]: r["n_docs"] for r in length_histogram(edge).collect()}
    assert h[0] == 2 and sum(h.values()) == 10 and context_totals(length_histogram(empty)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 1000])
def test_variable_length_codes(n):
    rng = np.random.default_rng(n)
    v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 33, n)).astype(np.uint32)
    control, data = pack(v)
    assert len(control) == (n + 3) // 4 and (unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v).all()


def test_shard_round_trip():
    rank, back = np.array([1, 0, 2], np.uint32), np.array([1, 0, 2], np.uint32)
    content = shard_bytes([None, 5], [b"", np.array([2, 1, 0], "<u2").tobytes()], rank, "<u2", 9)
    docs, counts, got, before = shard_read(content, back)
    assert docs == [None, 5] and counts.tolist() == [0, 3] and got.tolist() == [2, 1, 0] and before == 9
    with pytest.raises(ValueError):
        shard_read(b"none" + content[4:], back)


def test_op9(spark, sf, documents):
    got = QUERIES["op9_token_files"](spark, sf).toPandas().sort_values("doc_id")
    at = 0
    for r, row in zip(documents.orderBy("doc_id").collect(), got.itertuples(), strict=True):
        e = [*WORDS.tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (r["doc_id"], at, len(e), zlib.crc32(np.array(e, "<u4").tobytes()))
        at += len(e)


def test_files_edges(edge, empty):
    out = token_files(edge).toPandas().sort_values("start")
    assert np.isnan(out.doc_id.iloc[0]) and out.doc_id.iloc[1:].is_monotonic_increasing and out.start.tolist() == [0, *np.cumsum(out.n_tokens)[:-1].tolist()]
    assert out[out.doc_id.isin([2, 3, 6])].n_tokens.tolist() == [1, 1, 1] and len(out) == 10
    assert token_files(empty).count() == 0


def test_rows_of_one_id_are_parted(spark):
    """A third and more of the rows share an id, some of them their text as well: several shards parts have them, and starts follow one another."""
    rows = [(5, f"word{i % 40} and more words") for i in range(400)] + [(5, "the same") for _ in range(300)] + [(i, f"text {i}") for i in range(300)] + [(None, None)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = token_files(df)
    got = out.orderBy("start").toPandas()
    assert len(got) == len(rows) and got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1].tolist()]
    assert got.doc_id.isna().sum() == 300 and got.doc_id[:300].isna().all() and got.doc_id[300:].is_monotonic_increasing
    tokens = written(tokenized(df), "tokens")
    shards, _ = write_token_files(tokens, WORDS.size, 2, parts=8)
    assert shards.select("part").distinct().count() >= 6


def test_whole_number_quantiles(spark):
    """A share that is met exactly, and one that is missed by one document in three billions."""
    h = spark.createDataFrame([(1, 1_500_000_000), (2, 1_500_000_001), (3, 0)], "n_tokens long, n_docs long").where("n_docs > 0")
    t = context_totals(h)
    assert [r["context_limit"] for r in quantiles(t, [0.5, 0.4999999998, 1.0]).collect()] == [2, 1, 2]
    assert totals_at(h, [1, 5]).orderBy("context_limit").collect()[0]["docs_over"] == 1_500_000_001
    assert [r["tokens_truncated"] for r in totals_at(h.where("false"), [3]).collect()] == [0] and totals_at(h, []).count() == 0
    assert quantiles(t.where("false"), [0.5]).head()["context_limit"] is None and quantiles(t, []).count() == 0


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    no = lambda *_: None
    directory = Plain(isDefined=lambda: False)
    sc = Plain(master=master, getConf=lambda: Plain(get=no), _jsc=Plain(sc=lambda: Plain(getCheckpointDir=lambda: directory)))
    with pytest.raises(ValueError, match="share"):
        shared_root(Plain(sparkContext=sc, conf=Plain(get=no)))
