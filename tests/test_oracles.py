"""Every registered query against its SQL on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from lograft.plans.oracles import ORACLES
from lograft.plans.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(row[i] for i in order) for row in rows),
        key=lambda t: tuple((x is None, str(x)) for x in t),
    )


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(got, df.columns) == canonical(cursor.fetchall(), columns)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
