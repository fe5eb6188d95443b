import math

import duckdb
import pytest

from logloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr(tuple(clean(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = df.collect()
    if name in catalogue.ORACLE_SQL:
        out = duck.execute(catalogue.ORACLE_SQL[name])
        columns = [c[0] for c in out.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, out.fetchall())
