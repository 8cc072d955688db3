import duckdb
import pytest

import millrace.plans.catalogue
import millrace.plans.relational  # noqa: F401
from millrace.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import os

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(rows):
    return sorted(([tuple(r) for r in rows]), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = got.select(*sorted(got.columns)).collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in sorted(got.columns))} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(rows) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0 and set(e.oracle_sql()) <= set(e.queries())
