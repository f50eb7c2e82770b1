"""Every query of the catalog against its SQL on another engine."""

import os

import duckdb
import pytest

from ledgerflow.plans import catalog, mechanisms  # noqa: F401 (adds its queries)

catalog.check_names()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in ("events", "documents", "conversations"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(str(tuple(r)) for r in got.select(*columns).collect())
    want = db.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert rows == sorted(map(str, want))
    assert rows or name in ()
