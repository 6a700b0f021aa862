"""Every registered query against its SQL counterpart, and what its plan may contain."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from strictpast.testbed.oracle import ORACLE
from strictpast.testbed.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    # Adding zero turns the negative zero of a rounded tiny number into plain zero.
    clean = lambda v: v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(row[i]) for i in order) for row in rows), key=lambda r: [str(v) for v in r])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("NestedLoop", "Cartesian", "PythonUDF", "InPandas", "BatchEvalPython"):
        assert banned not in plan, f"{banned} in the plan of {name}"
    found = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    types = {c[0]: str(c[1]) for c in found.description}
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields} == types
    assert canonical(df.collect(), df.columns) == canonical(want, columns)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
