"""Every registered query with SQL against that SQL, at the smallest scale."""

import decimal
import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from quire import registry

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    if isinstance(v, (float, decimal.Decimal, int)):
        return float(f"{float(v):.9g}") + 0.0
    return str(v)


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SMALL):
        made.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return made


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = Counter(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_the_others_give_the_same_twice(spark, name):
    one, two = (registry.QUERIES[name](spark, SMALL) for _ in range(2))
    assert one.schema == two.schema
    assert Counter(map(repr, one.collect())) == Counter(map(repr, two.collect()))


def test_the_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 200 and "n_words" in df.columns


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(registry.QUERIES) <= set(queries)
    assert all(re.fullmatch(r"[a-z0-9_]+", k) and callable(f) for k, f in queries.items())


def test_no_local_checkpoints():
    root = os.path.dirname(os.path.abspath(registry.__file__))
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                assert "localCheckpoint" not in open(os.path.join(folder, f)).read(), f
