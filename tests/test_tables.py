import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.frame import TextTable
from millrace.operators.groups import generate_groups, generate_many, group_sizes
from millrace.operators.index_mapper import IndexMapper
from millrace.operators.model import TENSOR, element_type, infer, infer_batches, run_graph
from millrace.sources import csv, sinks


def simple(spark):
    return TextTable.of(spark, [[1, 2, 3], ["a1", "a2", "a3"], [1.1, 1.2, 1.3]], ["Id", "A", "B"])


def test_frame_views(spark):
    t = simple(spark)
    assert (t.n_cols(), t.n_rows(), t.header()) == (3, 3, ["Id", "A", "B"])
    assert t.raw_rows() == [("1", "a1", "1.1"), ("2", "a2", "1.2"), ("3", "a3", "1.3")] and t.raw_cols(["B", "A"]) == [["1.1", "1.2", "1.3"], ["a1", "a2", "a3"]]
    assert t.col("Id", "int") == [1, 2, 3] and t.icol(2, "double") == [1.1, 1.2, 1.3] and t.raw_icols([1]) == [["a1", "a2", "a3"]]
    assert t.rows(["B", "Id"], ["double", "int"]) == [(1.1, 1), (1.2, 2), (1.3, 3)] and t.irows([0], ["int"]) == [(1,), (2,), (3,)]
    assert t.col("A", "string", F.upper) == ["A1", "A2", "A3"] and t.raw_irows([0, 1])[0] == ("1", "a1")
    for bad in (lambda: t.icol(5), lambda: t.col("no"), lambda: t.drop_col("no"), lambda: t.drop_row(9)):
        with pytest.raises((IndexError, KeyError)):
            bad()
    with pytest.raises(Exception):
        t.col("A", "int")


def test_frame_changes(spark):
    t = simple(spark)
    assert t.insert_col([7, 8, 9], "C").col("C", "int") == [7, 8, 9] and t.insert_row([4, "a4", 1.4]).raw_rows()[-1] == ("4", "a4", "1.4")
    assert t.drop_col("A").raw_rows()[0] == ("1", "1.1") and t.drop_icol(0).header() == ["A", "B"] and t.drop_row(1).col("Id", "int") == [1, 3]
    assert t.drop_row(1).data().orderBy("_pos").select("_pos").collect()[1][0] == 1 and t.set_value(1, "A", "x").col("A") == ["a1", "x", "a3"]
    assert t.with_header(["x", "y", "z"]).header() == ["x", "y", "z"] and t.with_header([]).header() == []
    for bad in (lambda: t.insert_col([1], "C"), lambda: t.insert_col([1, 2, 3]), lambda: t.insert_row([1]), lambda: t.with_header(["a", "a", "b"]), lambda: t.with_header(["a", "", "b"]), lambda: t.with_header(["a"])):
        with pytest.raises(ValueError):
            bad()
    empty = TextTable.of(spark, [])
    assert empty.n_rows() == 0 and empty.insert_col([1, 2]).raw_rows() == [("1",), ("2",)]
    with pytest.raises(ValueError):
        empty.insert_row([])


def test_frame_index_and_print(spark):
    t = TextTable.of(spark, [["x", "y", "x"], [1, 2, 3], ["p", "q", "r"]], ["k", "v", "w"])
    assert {r["key"]: r["value"] for r in t.index_cols("k", ["v"], "string", ["int"]).collect()} == {"x": 1, "y": 2}
    assert {r["key"]: (r["v"], r["w"]) for r in t.index_cols("k", ["v", "w"]).collect()} == {"x": ("1", "p"), "y": ("2", "q")}
    assert str(simple(spark)) == "  Id|   A|    B\n----+----+-----\n   1|  a1|  1.1\n   2|  a2|  1.2\n   3|  a3|  1.3\n"


QUOTED = '  *Column| 1*| \t *Column| 2*  | * Column +*3+* *\nField 1| *Field|\n 2*  | * Field 3 *    \n*Field\n1*|   *Field| 2 * |   * Field 3 *    '


def test_csv_parse(spark):
    t = csv.read_csv_text(spark, "Id,  A,   B \n 1, a1, 1.1 \n 2, a2, 1.2 \r\n\n 3, a3, 1.3 \n")
    assert t.header() == ["Id", "A", "B"] and t.raw_rows()[2] == ("3", "a3", "1.3")
    assert csv.parse_table('Id,A,B\n,,\n , , \n"","",""')[1] == [["", "", ""]] * 3
    header, rows = csv.parse_table(QUOTED, separator="|", quote="*", escape="+")
    assert header == ["Column| 1", "Column| 2", " Column *3* "] and rows == [["Field 1", "Field|\n 2", " Field 3 "], ["Field\n1", "Field| 2 ", " Field 3 "]]
    assert csv.parse_table('"a\\nb",x\n"q"junk,y', has_header=False)[1] == [["anb", "x"], ["q", "y"]]
    assert csv.parse_table("skip\na,b\n1,2", drop=1) == (["a", "b"], [["1", "2"]])
    for bad in ("a,b\n1", 'a\n"x', "", "a,b\n1,2\n3"):
        with pytest.raises(csv.CsvError):
            csv.parse_table(bad)
    with pytest.raises(ValueError):
        csv.read_csv_text(spark, "a,a\n1,2")


def test_csv_write(spark, tmp_path):
    t = csv.read_csv_text(spark, QUOTED, separator="|", quote="*", escape="+")
    text = csv.csv_text(t, "|", "*", "+")
    assert text == "*Column| 1*|*Column| 2*|* Column +*3+* *\nField 1|*Field|\n 2*|* Field 3 *\n*Field\n1*|*Field| 2 *|* Field 3 *\n"
    path = str(tmp_path / "one")
    csv.write_csv(t, path, "|", "*", "+")
    again = csv.read_csv(spark, path, separator="|", quote="*", escape="+")
    assert again.header() == t.header() and again.raw_rows() == t.raw_rows()
    plain = TextTable.of(spark, [list(range(50)), ["x"] * 50], ["a", "b"])
    csv.write_csv(plain, str(tmp_path / "many"), single=False)
    assert csv.read_csv(spark, str(tmp_path / "many")).raw_rows() == plain.raw_rows()
    fast = csv.read_csv_fast(spark, str(tmp_path / "many"))
    assert fast.count() == 50 and fast.columns == ["a", "b"]
    bare = TextTable.of(spark, [["1"], ["2"]])
    assert csv.csv_text(bare) == "1,2\n"
    with pytest.raises(Exception):
        csv.read_csv(spark, str(tmp_path / "nothing"))


def test_groups(spark):
    assert group_sizes(10, [1.5, 1.5]) == [5, 5] and group_sizes(10, [1.5, 0, 1.5]) == [5, 0, 5] and group_sizes(11, [0, 8, 3, 3, 0]) == [0, 6, 2, 3, 0] and group_sizes(2, [1, 1, 1, 1]) == [1, 1, 0, 0]
    df = spark.range(11)
    got = generate_groups(df, [0, 8, 3, 3, 0], "id").groupBy("group").count().collect()
    assert {r["group"]: r["count"] for r in got} == {1: 6, 2: 2, 3: 3}
    assert generate_groups(df.repartition(5), [1, 1], "id", 4).orderBy("id").collect() == generate_groups(df, [1, 1], "id", 4).orderBy("id").collect()
    assert sorted(generate_groups(df, [1, 1], "id", 4, small=-1).collect()) == sorted(generate_groups(df, [1, 1], "id", 4).collect())
    for small in (1 << 30, -1):
        many = generate_many(spark.range(20), 2, [0.3, 0.3], [0.2, 0.2], "id", small=small).toPandas()
        for k in (0, 1):
            assert many[f"group_{k}"].value_counts().to_dict() == {0: 6, 1: 6, 2: 4, 3: 4}
        assert (many.group_0 != many.group_1).any() and ((many.group_0 >= 2) == (many.group_1 >= 2)).all() and (many[many.group_0 >= 2].group_0 == many[many.group_0 >= 2].group_1).all()
    with pytest.raises(ValueError):
        group_sizes(3, [0, 0])


def test_index_mapper(spark):
    m = IndexMapper.of(spark, ["first", "second", "third"])
    df = spark.createDataFrame([(0, "second"), (1, "bogus"), (2, "first"), (3, "third"), (4, "fourth")], "k int, v string")
    assert [r["i"] for r in m.encode(df, "v", "i", 10).orderBy("k").collect()] == [1, 10, 0, 2, 10]
    with pytest.raises(Exception, match="no index"):
        m.encode(df, "v", "i").collect()
    assert m.index_for("third") == 2 and m.index_for("x", 7) == 7 and m.at(0) == "first" and m.contains("first") and not m.contains("x") and m.size() == 3
    for bad, error in ((lambda: m.index_for("x"), KeyError), (lambda: m.at(9), IndexError), (lambda: m.insert("first"), ValueError), (lambda: IndexMapper.of(spark, ["a", "a"]), ValueError)):
        with pytest.raises(error):
            bad()
    assert m.insert("x").index_for("x") == 3
    more, flags = m.try_insert("first", "y", "y")
    assert flags == [False, True, False] and more.values() == ["first", "second", "third", "y"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["bum", "bada", "bum", "bum", "bada", "yeah!"])], "k int, v string")
    u = IndexMapper.unique(rows, "v", "k")
    assert u.values() == ["bum", "bada", "yeah!"]
    assert [r["w"] for r in u.decode(u.encode(rows, "v", "i"), "i", "w").orderBy("k").collect()] == ["bum", "bada", "bum", "bum", "bada", "yeah!"]
    with pytest.raises(Exception, match="no value"):
        u.decode(spark.createDataFrame([(9,)], "i int"), "i", "w").collect()
    lists = spark.createDataFrame([(0, ["yeah!", "bum"]), (1, [])], "k int, a array<string>")
    assert [r["x"] for r in u.encode_array(lists, "k", "a", "x").orderBy("k").collect()] == [[2, 0], []]


def test_host_batch_and_range(tmp_path):
    b = sinks.Batch({"Int": [0, 1, 2]})
    assert b.take(2).at("Int") == [0, 1] and b.at("Int") == [2]
    with pytest.raises(RuntimeError):
        b.take(4)
    b.push_back(sinks.Batch({"Int": [3, 4], "Double": [1.0]}))
    assert b.extract("Int") == [2, 3, 4] and b.size() == 2 and b.contains("Double")
    with pytest.raises(RuntimeError):
        b.batch_size()
    b.erase("Double")
    b.insert_or_assign("X", [1, 2, 3])
    assert b.batch_size() == 3 and b.to_python() == {"Int": [2, 3, 4], "X": [1, 2, 3]} and sinks.Batch().batch_size() == 0
    with pytest.raises(KeyError):
        b.at("no")
    r = sinks.Range(list(range(10)))
    for i in range(-15, 15):
        for j in range(-15, 15):
            assert list(r[i:j]) == list(range(10))[i:j]
    assert len(r) == 10 and r[-1] == 9 and list(sinks.Range(iter([1, 2]))) == [1, 2]
    with pytest.raises(ValueError):
        r[::2]
    path = sinks.create_temp_directory(str(tmp_path / "t%%%%"))
    assert "%" not in path
    a = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert (sinks.decode_image(sinks.encode_image(a)) == a).all() and sinks.point({"x": 1.0, "y": 2.0}) == (1.0, 2.0)


def test_inference(spark):
    assert run_graph(lambda x: x.T + 1, [[0, 1, 2, 3, 4, 5]], [(2, 3)]) == ([[1, 4, 2, 5, 3, 6]], [[3, 2]])
    df = spark.createDataFrame([(1, ([0.0, 1.0, 2.0, 3.0, 4.0, 5.0], [2, 3]))], f"k int, x {TENSOR}")
    y = infer(df, lambda: lambda x: x.T + 1, ["x"], ["y"]).head()["y"]
    assert (y["data"], y["shape"]) == ([1.0, 4.0, 2.0, 5.0, 3.0, 6.0], [3, 2])
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "k int, f array<double>")
    assert sorted(r["s"] for r in infer_batches(rows, lambda: lambda m: m.sum(axis=1), "f", "s").collect()) == [3.0, 7.0]
    assert element_type("float32").simpleString() == "float"
    with pytest.raises(TypeError):
        element_type("complex64")


def test_groups_of_larger_inputs_are_not_sorted(spark, monkeypatch):
    """Cuts sought by counts give the groups of the ranks; where hashes are equal, and for null, text and nested keys too. Repeated keys raise."""
    from millrace.operators import groups as G

    def same(df, key):
        one, two = ([*generate_groups(df, [0.2, 0, 0.5, 0.3], key, 7, small=s).collect()] for s in (1 << 30, -1))
        assert sorted(one, key=str) == sorted(two, key=str) and len(one) == df.count()
        one, two = (generate_many(df, 3, [0.25, 0.25], [0.5], key, 7, small=s) for s in (1 << 30, -1))
        assert one.columns == two.columns and sorted(one.collect(), key=str) == sorted(two.collect(), key=str)

    odd = spark.createDataFrame([(None,), ("",), ("a",), ("é",), ("b'\"",)], "key string").union(spark.range(500).selectExpr("cast(id as string)"))
    nested = spark.range(60).selectExpr("named_struct('a', id % 7, 'b', array(id)) as key")
    same(odd, "key")
    same(spark.range(0), "id")
    monkeypatch.setattr(G, "numbered", None)  # no ranking of rows
    G.generate_many(odd, 2, [1], [1], "key", small=-1).collect()
    monkeypatch.undo()
    few = lambda seed, *path: F.length(F.concat(*(p.cast("string") for p in path)))
    monkeypatch.setattr(G, "bits", lambda seed, *path: F.coalesce(few(seed, *path), F.lit(0)).cast("long") % 3)
    for df, key in ((odd, "key"), (nested, "key"), (spark.range(1000), "id")):
        same(df, key)
    monkeypatch.undo()
    for df in (spark.range(50).union(spark.range(1)), odd.union(spark.createDataFrame([(None,)], "key string"))):
        for small in (1 << 30, -1):
            with pytest.raises(Exception, match="repeat"):
                generate_groups(df, [1, 1], df.columns[0], small=small).collect()
