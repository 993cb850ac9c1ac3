"""Every registered query against the same question in SQL on another engine, whole tables, any row order."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import DATA
from spokeflow.plans.oracle import ORACLE
from spokeflow.plans.slate import QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def oracle(sf, sql):
    engine = duckdb.connect()
    for name in TABLES:
        engine.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{sf}/{name}.parquet'")
    found = engine.execute(sql)
    columns = [(d[0], str(d[1])) for d in found.description]
    return columns, found.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, name, sf):
    df = contract.queries()[name](spark, str(DATA / sf))
    columns, expected = oracle(sf, contract.oracle_sql()[name])
    assert sorted((f.name, TYPES[f.dataType.simpleString()]) for f in df.schema) == sorted(columns)
    assert canonical(df.columns, df.collect()) == canonical([c for c, _ in columns], expected)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    check(spark, name, "sf0.01")


def test_entry(spark):
    assert contract.entry(spark).count() > 0
