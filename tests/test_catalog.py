"""Every registered query of the core against its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from recollect.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def db():
    d = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        d.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return d


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    found = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in found.collect()]
    if name in ORACLE_SQL:
        told = db.execute(ORACLE_SQL[name])
        columns = [c[0] for c in told.description]
        assert sorted(columns) == sorted(found.columns)
        assert rows(got, found.columns) == rows(told.fetchall(), columns)
    else:
        assert got
