"""Every registered query of the catalogue against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from sluice.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canonical(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in catalogue.ORACLE:
        assert got
        return
    found = db.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE[name]})")
    assert [KINDS[str(d[1])] for d in found.description] == [dict(df.dtypes)[c] for c in columns]
    assert canonical(got) == canonical(found.fetchall())
