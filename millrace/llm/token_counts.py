"""Token totals for every context limit from an exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._common import _memos, chunks, pick, vocabulary, written
from millrace.llm.bpe import WHITE, Memo

#: Lengths in one block of the two-level suffix sums.
BLOCK = 64


class Lengths:
    """Tokens of a text under a tiktoken vocabulary without special tokens; text is cut before white space, where no token of the pattern reaches over."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ascii = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+").findall
        self.wide = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.spans = Memo(lambda x: len(self.encoding.encode_ordinary(x)))
        _memos.append(self.spans.empty)

    def of(self, text: str) -> int:
        return sum(map(self.spans.__getitem__, self.ascii(text) if text.isascii() else self.wide(text)))


@lru_cache(2)
def lengths(path: str) -> Lengths:
    return Lengths(path)


def length_histogram(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many rows have each encoded length, as a written table, so that what reads it doesn't encode the texts again.

    Each task sends its own histogram only. Null or empty text: length 0. An empty table gives no rows; other columns, repeated rows and ids don't matter.
    """
    path = path or vocabulary("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = lengths(path).of, Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                seen.update(map(of, part.column("text").to_pylist()))
        if seen:
            yield pa.RecordBatch.from_pydict({"n_tokens": [*seen], "n_docs": [*seen.values()]}, pa.schema([("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

    parts = pick(df, text_col, text_col).select("text").mapInArrow(run, "n_tokens long, n_docs long")
    return written(parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "token-lengths")


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: documents and tokens in all, those that fit, and what truncation leaves.

    Columns: context_limit, n_docs (of exactly this length), docs_over, tokens_over (of longer documents), docs_fit,
    tokens_truncated (the total when every longer document is cut to the limit), tokens_lost, share (of documents that fit, to nine digits, for
    reading: ``quantiles`` compares whole numbers). Between two lengths of the histogram the same suffix sums hold: ``totals_at``. Suffix sums
    go over blocks of ``BLOCK`` lengths first, then within each block, so no task sees the whole histogram; one task sees a row for each block, at most the longest text's tokens / ``BLOCK``.
    Empty input: no rows.
    """
    h = histogram.select(F.col("n_tokens"), F.col("n_docs"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select("block", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "dt"))
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    s = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "d_all", "t_all",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_above")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("t_above")).alias("tokens_over"),
    )
    kept = F.col("t_all") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")
    return s.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", "docs_over", "tokens_over", (F.col("d_all") - F.col("docs_over")).alias("docs_fit"),
        kept.alias("tokens_truncated"), (F.col("t_all") - kept).alias("tokens_lost"), F.round((F.col("d_all") - F.col("docs_over")) / F.col("d_all"), 9).alias("share"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over, tokens_truncated for the given limits: one row each, in one pass over the histogram. An empty histogram gives zeros, no limit no rows."""
    limits = [int(x) for x in dict.fromkeys(limits)]
    n, docs, none = F.col("n_tokens"), F.col("n_docs"), F.lit(0).cast("long")
    sums = [f(n, x) for x in limits for f in (lambda n, x: F.sum(F.when(n > x, docs)), lambda n, x: F.sum(F.least(n, F.lit(x)) * docs))]
    one = histogram.agg(F.lit(0).alias("_"), *(F.coalesce(s, none).alias(f"s{i}") for i, s in enumerate(sums)))
    rows = [F.struct(F.lit(x).cast("long").alias("context_limit"), F.col(f"s{2 * i}").alias("docs_over"), F.col(f"s{2 * i + 1}").alias("tokens_truncated")) for i, x in enumerate(limits)]
    kind = "array<struct<context_limit:bigint,docs_over:bigint,tokens_truncated:bigint>>"
    return one.select(F.explode(F.array(*rows).cast(kind)).alias("r")).select("r.*")


def quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """share, context_limit: the shortest limit that at least this share of the documents fit in, from ``context_totals``; null for an empty table.

    Shares are taken as the decimal fractions that they are written as, and compared with counts as whole numbers.
    """
    least = []
    for q in shares:
        f = Fraction(str(q)).limit_denominator(10**12)
        over, under = (F.lit(x).cast("decimal(13,0)") for x in (f.numerator, f.denominator))
        fits = F.col("docs_fit").cast("decimal(20,0)") * under >= (F.col("docs_fit") + F.col("docs_over")).cast("decimal(20,0)") * over
        least.append(F.struct(F.lit(float(q)).alias("share"), F.min(F.when(fits, F.col("context_limit"))).alias("context_limit")))
    return totals.agg(F.array(*least).cast("array<struct<share:double,context_limit:bigint>>").alias("r")).select(F.explode("r").alias("r")).select("r.*")
