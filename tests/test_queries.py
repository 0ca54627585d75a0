import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from sylva.queries import graph, problems

CORE = {**graph.QUERIES, **problems.QUERIES}
SQL = {**graph.ORACLE, **problems.ORACLE}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if x is None or x != x:
            return x if x is None else "NaN"
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(repr(plain(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = CORE[name](spark, SMALL)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "sylva")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"sylva\.llm|from sylva import llm", open(os.path.join(folder, f)).read()), f
