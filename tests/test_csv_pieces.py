import random

import pytest

from millrace.sources import csv

SPACE = " \t\n\v\f\r"


def plain_rows(text, separator=",", quote='"', escape="\\"):
    """The dialect, character by character."""
    at, n, out = 0, len(text), []
    skip = lambda i, chars: next((k for k in range(i, n) if text[k] not in chars), n)
    at = skip(at, SPACE)
    while at < n:
        row, more = [], True
        while more:
            at = skip(at, " \t")
            if at < n and text[at] == quote:
                field, at = "", at + 1
                while True:
                    if at >= n:
                        raise csv.CsvError("open")
                    if text[at] == escape and at + 1 < n:
                        field, at = field + text[at + 1], at + 2
                    elif text[at] == quote:
                        break
                    else:
                        field, at = field + text[at], at + 1
                row.append(field)
                while at < n and text[at] not in (separator, "\n"):
                    at += 1
            else:
                begin = at
                while at < n and text[at] not in (separator, "\n"):
                    at += 1
                row.append(text[begin:at].strip(SPACE))
            more = at < n and text[at] == separator
            at += more
        out.append(row)
        at = skip(at, SPACE)
    return out


def test_rows_against_the_dialect():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice('a,"\\\n \t\rb') for _ in range(rng.randrange(14)))
        sep = rng.choice(",\t")
        try:
            want = plain_rows(text, sep)
        except csv.CsvError:
            with pytest.raises(csv.CsvError):
                list(csv.parse_rows(text, sep))
            continue
        assert list(csv.parse_rows(text, sep)) == want, repr(text)


def test_long_fields_take_linear_time():
    for body in ('"' + "\\" * 400_001, '"' + "a" * 400_000, " " * 400_000 + '"', '"' + '\\"' * 200_000):
        with pytest.raises(csv.CsvError):
            list(csv.parse_rows(body))
    assert len(next(csv.parse_rows("x," * 200_000))) == 200_001


@pytest.fixture
def pieces(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, str(v)) for k, v in zip(old, (size, 0), strict=True)]
    for k, v in old.items():
        spark.conf.set(k, v)


def table(rng, rows):
    words = ['plain', ' padded ', 'quo"te', 'two\nlines', '', 'com,ma', 'back\\slash', 'three\n\nlines, "x"\n', '\ttab', 'é🎉']
    return [["a", "b\nb", "c"]] + [[rng.choice(words) for _ in range(3)] for _ in range(rows)]


@pytest.mark.parametrize("size", [60, 200, 100_000])
def test_files_in_pieces(spark, tmp_path, pieces, size):
    rng = random.Random(size)
    want = []
    for name in ("x1.csv", "x2.csv", "x3.csv"):
        rows = table(rng, 12)
        want += rows[1:]
        (tmp_path / name).write_text("".join(csv.write_csv_row(r) for r in rows) + "\n \n")
    pieces(size)
    got = csv.read_csv(spark, str(tmp_path))
    assert got.header() == ["a", "b\nb", "c"] and got.raw_rows() == [tuple(r) for r in want if any(r) or len(r) > 1]


def test_a_field_over_many_pieces(spark, tmp_path, pieces):
    big = "\n".join(f'line {i} with "quotes", commas and \\ escapes' for i in range(60))
    rows = [["k", "v"], ["1", big], ["2", "x"], [big, big], ["3", "y"]]
    (tmp_path / "f.csv").write_text("".join(csv.write_csv_row(r) for r in rows))
    pieces(64)
    assert csv.read_csv(spark, str(tmp_path / "f.csv")).raw_rows() == [tuple(r) for r in rows[1:]]
    none = csv.read_csv(spark, str(tmp_path / "f.csv"), has_header=False)
    assert none.names is None and none.raw_rows()[0] == ("k", "v") and none.n_rows() == 5


def test_what_raises(spark, tmp_path):
    for name, text in {"open": 'a,b\n1,"x\n', "ragged": "a,b\n1,2\n3\n", "empty": ""}.items():
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(Exception, match="field|header"):
            csv.read_csv(spark, str(tmp_path / f"{name}.csv")).raw_rows()
    (tmp_path / "two").mkdir()
    (tmp_path / "two/a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "two/b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(Exception, match="differ"):
        csv.read_csv(spark, str(tmp_path / "two")).raw_rows()
    assert csv.read_csv(spark, str(tmp_path / "two/a.csv"), drop=1).header() == ["1", "2"]
