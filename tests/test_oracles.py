"""Every query that has SQL gives the rows of the SQL."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from tessera.jobs.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(r[i] for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = rows(frame.columns, frame.collect())
    assert got == rows(names, want.fetchall())


def test_entry_and_registration(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert os.path.exists("/root/testdata/sf0.001")
