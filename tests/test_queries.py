"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import decimal

import duckdb
import pytest

from tarnwatch.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    return tuple(map(plain, x)) if isinstance(x, list) else x


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(registry.oracle_sql()[name])
    theirs = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert ours == theirs
