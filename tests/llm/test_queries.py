"""The registered queries on the smallest driver tables: against their SQL, or against brute force."""

from __future__ import annotations

import zlib
from pathlib import Path

import pytest

from labelloom.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import linked_groups, shingles

duckdb = pytest.importorskip("duckdb")
SF_DIR = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    result = QUERIES[name](spark, str(SF_DIR))
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert sorted(tuple(r[c] for c in columns) for r in result.collect()) == sorted(cursor.fetchall())


def test_jaccard_join(spark, duck):
    sets = {i: shingles(t, 3) for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    groups = linked_groups(sets, 90, 100)
    found = QUERIES["op4_jaccard_join"](spark, str(SF_DIR)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {(i, len(sets[i]), groups[i]) for i in sets}


def test_language_id(spark, duck):
    known = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    found = QUERIES["op7_language_id"](spark, str(SF_DIR)).collect()
    assert len(found) == len(known) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)


def test_html_extract(spark, duck):
    import html
    import re

    found = {r.page_id: r.text for r in QUERIES["op1_html_extract"](spark, str(SF_DIR)).collect()}
    for page, source in duck.execute("SELECT page_id, html FROM pages").fetchall():
        body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert found[page] == "\n".join(b for b in blocks if b)


def test_token_file_covers_all_documents(spark, duck):
    rows = sorted(QUERIES["op10_token_file"](spark, str(SF_DIR)).collect())
    assert [r.doc_id for r in rows] == [i for (i,) in duck.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:])) and rows[0].start == 0
