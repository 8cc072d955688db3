"""The queries of this subpackage: name -> function of (spark, folder of tables), and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import bpe_round_trip
from millrace.llm.decontaminate import find_leaks
from millrace.llm.fill_in_middle import fill_in_middle, restored
from millrace.llm.license_scan import scan_licenses
from millrace.llm.lm_scoring import score_texts
from millrace.llm.media import jpeg_features, store_texts
from millrace.llm.ngram_join import ngram_components
from millrace.llm.secret_scan import KINDS, scan_secrets, spans_text
from millrace.llm.source_audit import audit_sources
from millrace.llm.token_counts import context_totals, length_histogram
from millrace.llm.token_files import token_files
from millrace.llm.toxicity import classify
from millrace.llm.warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jpeg_features(store_texts(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("thumbnail").cast("long").alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.substring("thumbnail", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")), F.col("n_images").cast("string"), "thumbnail_hash").alias("feature"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_totals(length_histogram(table(spark, sf_dir, "documents")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, spans = scan_secrets(table(spark, sf_dir, "documents")), F.col("spans")
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", *counts, F.sha2(spans_text(spans, base=True), 256).alias("base_sha256"), spans_text(spans).alias("spans"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_bpe": op2_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_join": op7_ngram_join,
    "op8_warc": op8_warc,
    "op9_token_files": op9_token_files,
    "op10_decontaminate": op10_decontaminate,
    "op11_source_audit": op11_source_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_lm_scoring": op13_lm_scoring,
}
ORACLE_SQL: dict[str, str] = {
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(a[t.i:t.i + 3], ' ') AS g FROM w, LATERAL unnest(range(1, greatest(len(a) - 3, 1) + 1)) t(i) WHERE len(a) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c::BIGINT AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = w.doc_id
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages), d AS (SELECT *, sha1(html) AS h FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT // (32 ** (3 - i % 4))::BIGINT % 32 + 1)::BIGINT, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, NULL::VARCHAR AS error FROM d
""",
    "op11_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
o AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n) AS total FROM o GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 1) // (coalesce(t.total, 0)::HUGEINT + v.v) AS p
FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN o USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM o GROUP BY 1, 2) JOIN v USING (lang)),
e AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 200
""",
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, substr(text, 1, least(x, y)) AS p, substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substr(text, greatest(x, y) + 1) AS s FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(x, y) - least(x, y) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
""",
}
