"""Every query next to its SQL on the smallest given tables."""

import os

import duckdb
import pytest
from conftest import rows_of

import __spark_entry__ as driver

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_entry(spark):
    assert driver.entry(spark).count() == 25


@pytest.mark.parametrize("key", sorted(driver.oracle_sql()))
def test_same_rows(spark, duck, key):
    result = duck.execute(driver.oracle_sql()[key])
    kinds = {d[0]: str(d[1]) for d in result.description}
    df = driver.queries()[key](spark, SF)
    assert {name: KINDS[kind] for name, kind in df.dtypes} == kinds
    order = [list(kinds).index(c) for c in sorted(kinds)]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()),
                  key=lambda row: tuple((v is not None, str(type(v)), v) for v in row))
    assert rows_of(df, *sorted(kinds)) == want


def test_new_doctor_query_accounts_for_every_request(spark):
    rows = driver.queries()["u1_add_doctors"](spark, SF).collect()
    assert len(rows) == len({r.request_seq for r in rows}) == spark.read.parquet(f"{SF}/customer.parquet").count()
    accepted = [r for r in rows if r.outcome == "accepted"]
    for column in ("phone", "email"):
        values = [r[column] for r in accepted if r[column] is not None]
        assert len(values) == len(set(values))
