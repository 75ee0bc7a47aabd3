"""Queries of this subpackage give the rows of their SQL."""

from pathlib import Path

import duckdb
import pytest

from passagemill.llm.queries import QUERIES
from passagemill.llm.sql import SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, name):
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(cursor.fetchall())
