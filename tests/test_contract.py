"""Every registered query against DuckDB on the smallest driver tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from contract import load_queries

duckdb = pytest.importorskip("duckdb")
SF_DIR = Path("/root/testdata/sf0.001")
QUERIES, ORACLE = load_queries()

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [[row[i] for i in order] for row in rows]
    keys = [tuple("~" if v is None else (f"{v:.6f}" if isinstance(v, float) else str(v)) for v in row) for row in cells]
    return [names[i] for i in order], [row for _, row in sorted(zip(keys, cells), key=lambda p: p[0])]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    result = QUERIES[name](spark, str(SF_DIR))
    cursor = duck.execute(ORACLE[name])
    columns, rows = canonical([c[0] for c in cursor.description], cursor.fetchall())
    got_columns, got = canonical(result.columns, [tuple(r) for r in result.collect()])
    assert got_columns == columns and len(got) == len(rows)
    for mine, theirs in zip(got, rows):
        for a, b in zip(mine, theirs):
            same = math.isclose(a, b, abs_tol=2e-6) if isinstance(a, float) and isinstance(b, float) else a == b
            assert same, (name, mine, theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, str(SF_DIR)).count() > 0


def test_entry(spark):
    import __spark_entry__

    result = __spark_entry__.entry(spark)
    assert set(result.columns) == {"category", "split", "n_rows", "n_chars"} and result.count() == 45
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
