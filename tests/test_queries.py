"""Every query beside DuckDB's answer to its SQL over the same tables."""

import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from tidemark import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value as both engines give it."""
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (datetime, date)):
        return str(x)
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    mine = rows_of(df.columns, df.collect())
    assert len(df.columns) == len(set(df.columns))
    if name in plans.SQL:
        found = duck.execute(plans.SQL[name])
        told = rows_of([d[0] for d in found.description], found.fetchall())
        assert mine[0] == told[0]
        assert mine[1] == told[1], (list((mine[1] - told[1]).items())[:3], list((told[1] - mine[1]).items())[:3])


def test_entry_points_import_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) - len(e.oracle_sql()))"], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert said.returncode == 0, said.stderr
