import random

import pytest

from millrace.sources import datasource as D
from millrace.sources.csv import parse_table, read_csv

TEXTS = ['name,  what \n"a ""x\\"y" , 1\r\n\n "two\nlines" rest,\tz z \n', 'name,what\n é ,"q,\\\\"\n', "name,what\n"]


@pytest.fixture
def folder(spark, tmp_path):
    D.register(spark)
    at = tmp_path / "in"
    at.mkdir()
    return at


def put(folder, name, text):
    (folder / name).write_text(text, newline="")


def test_rows_are_those_of_the_parser(spark, folder):
    for i, t in enumerate(TEXTS):
        put(folder, f"{i}.csv", t)
    put(folder, "_SUCCESS", "")
    df = spark.read.format("strict_csv").load(str(folder))
    assert df.columns == ["name", "what"] and df.rdd.getNumPartitions() == 3
    want = sorted(tuple(r) for t in TEXTS for r in parse_table(t)[1])
    assert sorted(map(tuple, df.collect())) == want
    one = spark.read.format("strict_csv").load(str(folder / "0.csv"))
    assert [tuple(r) for r in one.collect()] == [tuple(r) for r in read_csv(spark, str(folder / "0.csv")).raw_rows()]
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW strict USING strict_csv OPTIONS (path 'file://{folder}')")
    assert sorted(map(tuple, spark.sql("SELECT name, what FROM strict").collect())) == want


def test_many_rows_other_marks_and_no_header(spark, folder, monkeypatch):
    monkeypatch.setattr(D, "ROWS", 7)
    rng = random.Random(4)
    rows = [[rng.choice(["", "x", "a;b", "l\nm", "'", " s "]) + str(i), str(i)] for i in range(500)]
    quoted = lambda f: "'" + f.replace("/", "//").replace("'", "/'") + "'"
    put(folder, "a.txt", "dropped\n" + "".join(";".join(map(quoted, r)) + "\n" for r in rows))
    df = spark.read.format("strict_csv").option("header", "false").option("drop", 1).option("sep", ";").option("quote", "'").option("escape", "/").schema("x string, y string").load(str(folder))
    assert [list(r) for r in df.collect()] == rows


def test_wrong_files(spark, folder):
    read = lambda: spark.read.format("strict_csv").load(str(folder)).collect()
    with pytest.raises(Exception, match="give a schema"):
        read()
    assert spark.read.format("strict_csv").schema("a string").load(str(folder)).collect() == []
    put(folder, "a.csv", "x,y\n1,2\n3\n")
    with pytest.raises(Exception, match="1 fields instead of 2"):
        read()
    put(folder, "a.csv", 'x,y\n1,"2\n')
    with pytest.raises(Exception, match="doesn't end"):
        read()
    put(folder, "a.csv", "x,y\n1,2\n")
    put(folder, "b.csv", "x,z\n1,2\n")
    with pytest.raises(Exception, match="header"):
        read()
    put(folder, "a.csv", "x,x\n1,2\n")
    with pytest.raises(Exception, match="repeat"):
        spark.read.format("strict_csv").load(str(folder / "a.csv"))
    with pytest.raises(Exception, match="strings"):
        spark.read.format("strict_csv").schema("x int, y string").load(str(folder / "b.csv")).collect()


def test_a_stream_goes_on_after_a_restart(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    want = []
    for i, t in enumerate([TEXTS[0], TEXTS[1], "name,what\nlast,1\n"]):
        put(folder, f"{i}.csv", t)
        want += [tuple(r) for r in parse_table(t)[1]]
        source = spark.readStream.format("strict_csv").schema("name string, what string").option("maxFilesPerTrigger", 1).load(str(folder))
        q = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(want)
