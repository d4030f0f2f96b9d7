"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tessera.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int | float):
        return f"{float(v):.6g}"
    return str(v).replace(" 00:00:00", "")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    cur = duck.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    order = sorted(cols)
    want = sorted(tuple(plain(dict(zip(cols, r, strict=True))[c]) for c in order) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == want


NONE_AT_THIS_SIZE = {"refused_keys"}  # no key is contested in so few rows


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_queries_without_sql_give_rows(spark, name):
    assert queries()[name](spark, SF).isEmpty() == (name in NONE_AT_THIS_SIZE)
