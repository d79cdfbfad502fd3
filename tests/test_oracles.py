"""Every registered query against its SQL, over whole tables."""

import math
import os

import duckdb
import pytest

from batchloom.plans.oracles import ORACLES
from batchloom.plans.queries import QUERIES
from tests.conftest import TESTDATA

# One-row results: only partial aggregates of the tasks meet.
ALLOWED = {
    ("SinglePartition", name) for name in ("row_count", "audit_counts", "batch_run_report")
}
SF = os.environ.get("ORACLE_SF", "sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in (TESTDATA / SF).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, str(TESTDATA / SF))
    expected = duck.execute(ORACLES[name])
    names = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(names)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    assert {n: kinds[t] for n, t in result.dtypes} == {
        column[0]: str(column[1]) for column in expected.description
    }
    want = rows_of(names, expected.fetchall())
    got = rows_of(result.columns, [tuple(row) for row in result.collect()])
    assert len(got) == len(want)
    assert got == want
    plan = result._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "SinglePartition"):
        assert operator not in plan or (operator, name) in ALLOWED
