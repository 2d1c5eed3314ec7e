"""The registered queries with SQL, and the registry."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from textguard.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ORACLE)
def test_against_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    with duckdb.connect() as db:
        for table in ("embeddings", "pages", "documents"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        theirs = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    mine = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr) and len(mine) > 0


def test_registry():
    names = list(queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(ORACLE) <= set(oracle_sql())
