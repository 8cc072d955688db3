"""Secret scans: fixed patterns, and random strings found by how few characters a token of a public vocabulary covers in them."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import arrow_map, id_type, pick, unused, vocabulary

#: The base kinds in the order of equal starts, their patterns, and the least length of the group that counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a greedy run of 24 or more is a whole run
#: The kind of spans that the token test adds.
RANDOM = "random"

#: The token test's parameters: the shortest string, and the most characters a token covers in a random one on average.
LEAST = 20
RATIO = 2.0
#: What is known not to be a secret. Digests: hexadecimal of the usual digest lengths. UUIDs. Runs of one character, numbers.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})=*")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
PLAIN = re.compile(r"(.)\1*|[0-9+/_=-]+")
#: Known values in a longer string: with no letter or digit beside them.
KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|{DIGEST.pattern})(?![A-Za-z0-9])")
#: What stands between two '='. Parts of a name; those of up to SHORT characters tell nothing. Characters that are tokenized at once. In a part, digits in a row that are a number or a time.
FIELD = re.compile(r"[^=]+(?:=+\Z)?")
PART = re.compile(r"[A-Za-z0-9]+")
SHORT = 3
PIECE = 1024
NUMBER = re.compile(r"[0-9]{6,}")


class Bounds:
    """Spans as their union, in order, to be looked up in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def within(self, a: int, b: int) -> list[tuple[int, int]]:
        lo, hi = bisect_right(self.ends, a), bisect_left(self.starts, b)
        return list(zip(self.starts[lo:hi], self.ends[lo:hi], strict=True))


class Scanner:
    def __init__(self, path: str, ratio: float, least: int = LEAST):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ratio, self.least = ratio, least
        # runs of 24 hexadecimal digits lie in candidates too
        self.candidate = re.compile(rf"[A-Za-z0-9+/_=-]{{{min(least, 24)},}}")

    def tokens(self, text: str) -> int:
        """Tokens of a string, in pieces, so that the time is linear in its length."""
        return sum(len(self.encoding.encode_ordinary(text[i : i + PIECE])) for i in range(0, len(text), PIECE))

    def score(self, part: str) -> tuple[float, int]:
        """How many characters a part without joiners is short of ``ratio`` for each of its tokens (words have more: under 0), and how many
        characters tell that. Numbers, runs of one character and short parts tell nothing."""
        rest = [x for x in NUMBER.split(part) if x]
        n = sum(map(len, rest))
        if len(part) <= SHORT or part.isdigit() or part == part[0] * len(part):
            return 0.0, 0
        return self.ratio * sum(map(self.tokens, rest)) - n, n

    def random(self, text: str) -> bool:
        """Whether a string without spaces looks random: no known digest, few characters a token, and not only parts that are words."""
        if DIGEST.fullmatch(text) or UUID.fullmatch(text) or PLAIN.fullmatch(text):
            return False
        odd = sum(n for score, n in map(self.score, PART.findall(text)) if score > 0)
        return odd >= self.least // 2 and len(text) < self.ratio * self.tokens(text)

    def within(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Bounds of what looks random in a string without spaces: all of it, or each field, or a field's longest rows of parts that are no words. What is ``taken`` or known is passed over."""
        gone = Bounds(taken + [m.span() for m in KNOWN.finditer(text)])
        if len(text) >= self.least and not gone.within(0, len(text)) and self.random(text):
            return [(0, len(text))]
        out = []
        for field in FIELD.finditer(text):
            start, end = field.span()
            if end - start >= self.least and not gone.within(start, end) and self.random(field[0]):
                out.append((start, end))
                continue
            last, row = start, []  # the end of the last word, and (start, end, score, characters that tell) since
            parts = [(start + m.start(), start + m.end(), *self.score(m[0])) for m in PART.finditer(field[0])]
            for part in [*parts, (end, end, -1.0, 0)]:
                a, b, score, _ = part
                if score >= 0 and not gone.within(a, b):
                    row.append(part)
                    continue
                if row:
                    # one joiner belongs to the word beside it, further ones to the row
                    lo, hi = min(row[0][0], last + (last > start)), max(row[-1][1], a - (a < end))
                    if hi - lo >= self.least and sum(r[2] for r in row) > 0 and sum(r[3] for r in row if r[2] > 0) >= self.least // 2:
                        out.append((lo, hi))
                last, row = b, []
        return out

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out = []
        if ":" in text or "=" in text:
            out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
        if "AKIA" in text:
            out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found = [m.span() for m in self.candidate.finditer(text)]
        if found:  # a run of 24 hexadecimal digits lies in a candidate
            out += [("hex", *m.span()) for m in HEX.finditer(text)]
            taken = Bounds([(a, b) for _, a, b in out])
            for a, b in found:
                out += [(RANDOM, a + x, a + y) for x, y in self.within(text[a:b], [(x - a, y - a) for x, y in taken.within(a, b)])]
            order = {k: i for i, k in enumerate((*KINDS, RANDOM))}
            return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@lru_cache(2)
def scanner(path: str, ratio: float, least: int = LEAST) -> Scanner:
    return Scanner(path, ratio, least)


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _spans(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], _SPANS)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """doc_id, spans (array of kind, start, end in code points, end exclusive; by start, then kind): every row's whole text, in one pass without a shuffle.

    ``assign``, ``access`` and ``hex`` come from fixed patterns; ``random`` are further strings that no base span touches, without
    the words that ``=``, ``/`` and other joiners part from them. They have ``least`` characters or more: shorter ones aren't sought, and the shorter they may be, the more names and abbreviations are
    taken for random (the README has the shares by length). Hexadecimal of a digest's length and upper case counts as a digest, UUIDs and numbers as identifiers. Null or
    empty text: no spans. Null ids, repeated rows and other columns don't matter.
    """
    path = path or vocabulary("byte_bpe_50k.tiktoken")

    def make():
        s = scanner(path, ratio, least)

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), _spans([s.spans(t) for t in batch.column("text").to_pylist()])], ["doc_id", "spans"])

        return part

    return arrow_map(pick(df, id_col, text_col), make, f"doc_id {id_type(df, id_col)}, spans {SPANS}", "text")


def spans_text(spans: Column, base: bool = False) -> Column:
    """Spans as ``kind:start:end``, joined by commas; ``base``: without the token test's."""
    if base:
        spans = F.filter(spans, lambda s: s["kind"] != RANDOM)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, or run of spans that overlap, as ``<secret>``."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", path: str | None = None, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``df`` with the secrets of its texts (see ``scan_secrets``) replaced by ``<secret>``: every row and column stays, null texts stay null, clean texts stay as they are."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    name = unused(df, "redacted")
    names = [*df.columns, name]

    def make():
        s = scanner(path, ratio, least)

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(text_col).to_pylist()
            found = [s.spans(t) if t else [] for t in texts]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([redact(t, x) if x else None for t, x in zip(texts, found, strict=True)], pa.string())], names)

        return part

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` string"])
    out = arrow_map(df, make, schema, text_col)
    return out.withColumn(text_col, F.coalesce(name, text_col)).drop(name)
