import pytest
from pyspark.sql import functions as F

from millrace.llm.queries import ORACLE_SQL, QUERIES
from millrace.llm.warc import bare_digest, chunked, dechunked, read_warc, record, records, segments, warc_round_trip, write_warc


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_chunks(size):
    for data in (b"", b"x", b"0\r\n\r\n" * 50, bytes(range(256)) * 20):
        assert dechunked(chunked(data, size)) == data
    assert dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        dechunked(b"5\r\nab")


def test_records_and_segments():
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "u"}
    got = list(records(b"".join(segments(fields, b"abcdefghij", 4))))
    assert [b for _, b in got] == [b"abcd", b"efgh", b"ij"] and [h.get("warc-segment-number") for h, _ in got] == ["1", "2", "3"]
    assert got[2][0]["warc-segment-total-length"] == "10" and got[1][0]["warc-segment-origin-id"] == "<urn:uuid:1>" and len({h["warc-record-id"] for h, _ in got}) == 3
    assert len(list(segments(fields, b"abcd", 4))) == 1
    with pytest.raises(ValueError):
        list(records(record(fields, b"abc")[:-3] + b"zzz"))


ROWS = [(5, "u5", "abc"), (3, "u3", "abc"), (9, "u9", "abc"), (None, "x", "abc"), (1, None, None), (2, "u2", ""), (7, "u7", "é" * 9000), (8, "u8", "é" * 9000), (10, "w", "x" * 20000), (10, "w", "x" * 20000), (11, "w", "x" * 20000), (12, "y", "0\r\n\r\nWARC/1.1\r\n")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    got = warc_round_trip(pages).collect()
    assert len(got) == len(ROWS) and all(r["error"] is None for r in got)
    first = {5: 3, 9: 3, None: 3, 2: 1, 8: 7, 11: 10}
    text = {p: (h or "").encode() for p, _, h in ROWS}
    for r in got:
        p = r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[p]) if p in first else ("response", None))
        assert r["payload_bytes"] == len(text[p]) and r["payload_digest"] == bare_digest(text[p]) and (r["payload"] is None) == (p in first)
        assert r["payload"] is None or bytes(r["payload"]) == text[p]
    assert all(r["record_type"] == "response" for r in warc_round_trip(pages, 100).where("payload_bytes < 100").collect())
    assert warc_round_trip(pages.where("false")).count() == 0


def test_damage_is_told(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 40000)], "page_id long, url string, html string")
    archive = write_warc(pages, archive=1)  # each segment in an archive of its own
    rows = archive.orderBy("part", "seq").collect()
    assert len(rows) > 3 and read_warc(archive).head()["error"] is None
    errors = [read_warc(spark.createDataFrame(rows[:k] + rows[k + 1 :], archive.schema)).head()["error"] for k in (0, 1, len(rows) - 1)]
    assert errors == ["the first segment is missing", "segments are missing or repeat", "the total length differs"]
    other = [r.asDict() | {"content": bytes(r["content"]).replace(b"xxxxxxxx", b"xxxxyxxx", 1)} for r in rows]
    assert read_warc(spark.createDataFrame(other, archive.schema)).head()["error"] == "the payload digest differs"


def test_a_damaged_archive_stops_nothing(spark):
    pages = spark.createDataFrame([(i, "u", f"text {i} " * 50) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    rows = write_warc(pages, archive=1).orderBy("part", "seq").collect()
    assert len(rows) == 6
    broken = [r.asDict() for r in rows]
    broken[2]["content"] = bytes(broken[2]["content"])[:-30]  # the warcinfo record before it is whole
    broken[4]["content"] = b"nothing of the kind"
    got = read_warc(spark.createDataFrame(broken, "part int, seq int, content binary")).collect()
    assert len({r["page_id"] for r in got if r["error"] is None and r["payload_bytes"] == len(f"text {r['page_id']} " * 50)}) == 4
    assert sum(r["error"] is not None and r["error"].startswith("a damaged archive") and r["page_id"] is None for r in got) == 2


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.register("pages", spark.read.parquet(f"{sf}/pages.parquet").toPandas())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op8_warc']})").fetchall()
    assert sorted(want, key=repr) == sorted((tuple(r) for r in QUERIES["op8_warc"](spark, sf).select(*names).collect()), key=repr)


@pytest.mark.parametrize("kind", ["smallint", "tinyint", "int", "string"])
def test_kinds_of_page_ids(spark, kind):
    pages = spark.createDataFrame([(i, "u", f"text {i % 3}") for i in range(6)], "page_id long, url string, html string").withColumn("page_id", F.col("page_id").cast(kind))
    got = warc_round_trip(pages).collect()
    value = str if kind == "string" else int
    assert {r["page_id"]: r["refers_to"] for r in got} == {value(i): value(i - 3) if i > 2 else None for i in range(6)}
    with pytest.raises(TypeError, match="whole numbers or texts"):
        warc_round_trip(pages.withColumn("page_id", F.lit(1.5)))
