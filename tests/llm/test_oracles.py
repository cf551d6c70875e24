"""The queries that SQL can express whole, against DuckDB."""

import duckdb
import pytest

from corvane.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = duck.execute(ORACLES[name])
    columns = sorted(d[0] for d in found.description)
    want = sorted(map(repr, duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]}) q").fetchall()))
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    types = {d[0]: str(d[1]) for d in found.description}
    assert {c: kinds[k] for c, k in df.dtypes} == types
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want and want
