import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"
HERE = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_every_query_is_registered():
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("corpusloom.llm") is None:
        assert not any(name.startswith("op") and name[2].isdigit() for name in entry.queries())


@HERE
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@HERE
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_as_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(map('"{}"'.format, columns))} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == sorted(repr(tuple(map(plain, r))) for r in want)
