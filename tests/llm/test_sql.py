"""The SQL twins on whole tables, on another engine."""

import duckdb
import pytest

from spokeflow.llm import slate

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR"}


@pytest.mark.parametrize("name", slate.ORACLE)
def test_query(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    engine = duckdb.connect()
    for table in ("conversations", "embeddings"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = engine.execute(slate.ORACLE[name])
    columns = [(d[0], str(d[1])) for d in found.description]
    df = slate.QUERIES[name](spark, sf_dir).select(*[c for c, _ in columns])
    assert [(f.name, TYPES[f.dataType.simpleString()]) for f in df.schema] == columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())
