"""Token-id files: ids ranked by frequency, byte-aligned variable-length codes with separate control bytes, table-lookup decoding.

A shard's bytes, all little-endian: ``MRT1``, four unsigned 64-bit counts (documents, ids, data bytes, ids before the shard in its
part), a byte per document (1: it has an id), the document ids (signed 64-bit), their token counts (unsigned 32-bit), the control bytes
(four 2-bit lengths less 1 each, lowest bits first), the data bytes. Shards lie in a table ``shards`` (part, seq, n_ids, content)
and the ranks in a table ``ranks`` (rank, id): any store that Spark writes to can hold them, and Spark's committer keeps
a lost executor's half-written ones out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import _memos, chunks, forget, id_type, pick, vocabulary, written
from millrace.llm.bpe import WHITE, Memo, byte_symbols

#: Words in each of the two generations that a worker remembers.
MEMO = 600_000
MAGIC = b"MRT1"
#: Ids of one shard, unless a single document has more.
SHARD_IDS = 1 << 20

#: For each control byte: the lengths of its four codes.
LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values; the last control byte is filled with lengths of 1 that have no data."""
    values = values.astype("<u4")
    n = len(values)
    code = ((values > 0xFF).view(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)).astype(np.uint8)
    quads = np.zeros((n + 3) // 4 * 4, np.uint8)
    quads[:n] = code
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8) < lengths[:, None]] = data
    return out.view("<u4").reshape(-1)


class Words:
    """Ids of the library's tokenizer, remembered for each word between white space.

    For vocabularies whose normalizer and pre-tokenizer drop white space: no token, special token or composed character reaches over it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        self.known = Memo(self._word, MEMO)
        _memos.append(self.known.empty)
        self.model = self.tokenizer.model
        self.shown = dict(enumerate(byte_symbols()))
        self.marks = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, self.dtype).tobytes() for c in ",."}
        self.odd = re.compile("[\x1c-\x1f]").search  # str.split() drops them, the pattern's white space has none
        self.wide = re.compile(f"[^{WHITE}]+").findall

    def _core(self, word: str) -> bytes:
        """A word without case and a final mark. A lower-case word of letters in normal form is one piece for the model."""
        if word.isalpha() and word.islower() and is_normalized("NFC", word):
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.shown))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        core = word.lower() if word.isascii() else word
        # a mark after a letter is a token of its own, but not if the normalizer turns that letter into one with a mark that isn't a letter, as it does with some of Turkish and Hindi
        if core[-1] in self.marks and normalize("NFC", core[-2:-1]).lower()[-1:].isalpha():
            return self.known[core[:-1]] + self.marks[core[-1]]
        return self.known[core] if core is not word and core != word else self._core(core)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.wide(text) if self.odd(text) else text.split()))


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def tokenized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 2) -> DataFrame:
    """doc_id, ids (binary, little-endian, 2 bytes each if the vocabulary allows): each whole text's ids and the end id.

    Each task adds a row in which ``counts`` isn't null: how often it has put out each id (binary, 64-bit).
    """
    path = path or vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path)
        end = b"" if end_id is None else np.array([end_id], w.dtype).tobytes()
        counts = np.zeros(max(w.size, (end_id or 0) + 1), np.int64)
        names, some = ["doc_id", "ids", "counts"], None
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = [w.encode(t) + end for t in part.column("text").to_pylist()]
                counts += np.bincount(np.frombuffer(b"".join(ids), w.dtype), minlength=len(counts))
                some = part.column("doc_id")
                yield pa.RecordBatch.from_arrays([some, pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if some is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, some.type), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names)

    return pick(df, id_col, text_col).mapInArrow(run, f"doc_id {id_type(df, id_col)}, ids binary, counts binary")


def frequency_ranks(counts: DataFrame, size: int) -> DataFrame:
    """rank, id: every id that occurs, the most frequent first, ties by id, from the tasks' ``counts``. The table is as large as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                n += np.frombuffer(x, np.int64)
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["id", "n"])

    sums = counts.select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(((r["n"], r["id"]) for r in sums.collect()), key=lambda x: (-x[0], x[1]))  # `size` rows at most
    return counts.sparkSession.createDataFrame([(k, i) for k, (_, i) in enumerate(rows)], "rank int, id int")


def shard_bytes(doc_ids: list[int | None], ids: list[bytes], rank: np.ndarray, dtype: str, before: int) -> bytes:
    values = rank[np.frombuffer(b"".join(ids), dtype)]
    control, data = pack(values)
    width = np.dtype(dtype).itemsize
    head = np.array([len(doc_ids), len(values), len(data), before], "<u8").tobytes()
    has = np.array([x is not None for x in doc_ids], np.uint8).tobytes()
    return b"".join([MAGIC, head, has, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([len(x) // width for x in ids], "<u4").tobytes(), control, data])


def shard_read(content: bytes, back: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """Document ids, token counts, ids of all documents and the number of ids before the shard in its part."""
    if content[:4] != MAGIC:
        raise ValueError("not a token-id shard")
    n_docs, n_ids, n_data, before = (int(x) for x in np.frombuffer(content, "<u8", 4, 4))
    at = 36
    has = np.frombuffer(content, np.uint8, n_docs, at)
    doc_ids = np.frombuffer(content, "<i8", n_docs, at := at + n_docs)
    counts = np.frombuffer(content, "<u4", n_docs, at := at + 8 * n_docs)
    control = np.frombuffer(content, np.uint8, (n_ids + 3) // 4, at := at + 4 * n_docs)
    data = np.frombuffer(content, np.uint8, n_data, at + len(control))
    return [int(x) if h else None for x, h in zip(doc_ids, has, strict=True)], counts, back[unpack(control, data, n_ids)], before


def write_token_files(tokens: DataFrame, size: int, width: int, parts: int | None = None, shard_ids: int = SHARD_IDS) -> tuple[DataFrame, DataFrame]:
    """Writes the rows of ``tokenized`` in ascending doc_id order; gives the written tables (shards, ranks).

    ``tokens`` should be a written table: it is read three times (counts, range borders, shards). Ties of doc_id go by a hash of their ids,
    null ids come first. One range exchange; each task writes shards of bounded size one after another. Rows of one doc_id are parted by that hash, and equal rows,
    of which it doesn't matter which is first, by where they were read, so that no id's rows have to meet in a task.
    """
    spark = tokens.sparkSession
    ranks = written(frequency_ranks(tokens.where("counts is not null"), size), "token-ranks")
    dtype = f"<u{width}"
    rank = np.zeros(size, np.uint32)
    for r in ranks.collect():  # as many as the vocabulary at most
        rank[r["id"]] = r["rank"]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, docs, held, n_held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def shard() -> pa.RecordBatch:
            content = shard_bytes(docs, held, rank, dtype, before)
            schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("content", pa.binary())])
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_ids": [n_held], "content": [content]}, schema)

        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if docs and n_held + len(ids) // width > shard_ids:
                    yield shard()
                    seq, before, docs, held, n_held = seq + 1, before + n_held, [], [], 0
                docs.append(doc)
                held.append(ids)
                n_held += len(ids) // width
        if docs:
            yield shard()

    keys = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("place")]
    rows = tokens.where("counts is null").select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    return written(ordered.mapInArrow(run, "part int, seq int, n_ids long, content binary"), "token-shards"), ranks


def read_token_files(shards: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit), from the tables that ``write_token_files`` wrote."""
    rows = ranks.collect()  # as many as the vocabulary at most
    back = np.zeros(max((r["rank"] for r in rows), default=0) + 1, "<u4")
    for r in rows:
        back[r["rank"]] = r["id"]
    at, starts = 0, {}
    for r in sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["part"]):  # one for each part that the writer was given
        starts[r["part"]], at = at, at + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, content in zip(b.column("part").to_pylist(), b.column("content").to_pylist(), strict=True):
                docs, counts, ids, before = shard_read(content, back)
                ends = np.cumsum(counts.astype(np.int64))
                first = ends - counts
                raw = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
                edges = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(first + before + starts[part]), pa.array(counts.astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(docs), [None, edges, raw])],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return shards.select("part", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Encodes, writes and reads back every row of ``df``: doc_id, start, n_tokens, ids.

    Null or empty texts have the end id alone. Ids must be whole numbers or null; nulls come first; rows of equal ids follow one another, ordered by a hash of their tokens.
    An empty table gives no rows. Other columns don't matter.
    """
    path = path or vocabulary("word_bpe_49k.json")
    w = words(path)
    size = max(w.size, (end_id or 0) + 1)
    width = np.dtype(w.dtype).itemsize
    base = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    tokens = written(tokenized(base, path=path, end_id=end_id), "tokens")
    shards, ranks = write_token_files(tokens, size, width)
    forget(tokens)
    return read_token_files(shards, ranks)
