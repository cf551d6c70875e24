"""Every query with SQL of its own against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from corvane.plans import catalogue

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query_equals_its_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.oracles()[name])
    columns = [d[0] for d in want.description]
    rows = want.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rows, columns)
    assert rows or name == "bool_missing_term"


def test_every_query_has_rows(spark):
    assert set(catalogue.oracles()) <= set(catalogue.QUERIES)
    total = catalogue.QUERIES["pagerank_converged"](spark, SF).agg({"p": "sum"}).first()[0]
    assert abs(total - 1) < 1e-4
