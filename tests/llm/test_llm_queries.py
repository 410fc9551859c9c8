"""The queries with SQL against it, over whole tables."""

import duckdb
import pytest

from floodsift.llm.oracles import ORACLES
from floodsift.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = connection.execute(ORACLES[name])
    columns = sorted(c[0] for c in found.description)
    places = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted((tuple(r[p] for p in places) for r in found.fetchall()), key=repr)
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want
