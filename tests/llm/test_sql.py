"""The queries of this subpackage that SQL can express, beside DuckDB's answers."""

import sys
from pathlib import Path

import duckdb
import pytest

from tidemark.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from test_queries import SF, TABLES, rows_of  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    mine, found = rows_of(df.columns, df.collect()), con.execute(queries.SQL[name])
    told = rows_of([d[0] for d in found.description], found.fetchall())
    assert mine[0] == told[0] and mine[1] == told[1], (list((mine[1] - told[1]).items())[:2], list((told[1] - mine[1]).items())[:2])
