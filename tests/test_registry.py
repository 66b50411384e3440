"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest
from conftest import TESTDATA

from sylvaframe.plans.registry import ORACLE_SQL, QUERIES

SF = f"{TESTDATA}/sf0.001"
TABLES = ("region", "nation", "customer", "orders", "lineitem", "events", "conversations")


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(rows):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(map(tuple, got.collect())) == plain(rows)
