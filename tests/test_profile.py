from __future__ import annotations

import statistics

import numpy as np
import pytest

from labelloom.operators import profile as D
from labelloom.schema import NARRATIVE
from tests.conftest import SCHEMA


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (0, "short", "a", "x"), (1, "a text of more than twenty characters", "a", "x"), (2, None, "b", "x"),
        (3, "   ", "a", None), (4, "a text of more than twenty characters", "a", "x"), (5, None, "c", "y"),
        (6, "   padded text        ", "b", "y"), (7, "", None, "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_profile_and_nulls(raw):
    rows = {r["column_name"]: r for r in D.table_profile(raw).collect()}
    assert (rows[NARRATIVE]["non_null_count"], rows["issue"]["column_type"], rows["product"]["n_rows"]) == (6, "string", 8)
    nulls = [(r["column_name"], r["null_percent"]) for r in D.null_share_top(raw, 2).collect()]
    assert nulls == [(NARRATIVE, 25.0), ("issue", 12.5)]


def test_duplicate_share_treats_null_as_a_value(spark, raw):
    assert D.duplicate_share(raw.drop("record_id")).first()["duplicate_share"] == 1 / 8
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a"), ("null", "a")], "x string, y string")
    assert D.duplicate_share(df).first()["duplicate_share"] == 0.25


def test_yearly_counts_skip_bad_dates(spark):
    df = spark.createDataFrame([("2015-03-01",), ("2015-12-31",), ("2011-01-01",), ("soon",), (None,)], "d string")
    assert [tuple(r) for r in D.yearly_counts(df, "d").collect()] == [(2011, 1), (2015, 2)]


def test_text_availability_and_selection_bias(raw):
    shares = {r["text_missing"]: r["share"] for r in D.text_availability(raw).collect()}
    assert shares == {True: 0.25, False: 0.75}
    rows = {r["product"]: r for r in D.selection_bias(raw).collect()}
    assert rows["a"]["raw_share"] == 4 / 7 and rows["a"]["text_share"] == 3 / 4
    assert rows["c"]["text_share"] is None and rows["c"]["delta"] is None
    assert list(rows) == ["a", "b", "c"]


def test_eda_slice_measures_unstripped_text(raw):
    assert sorted(r["record_id"] for r in D.eda_slice(raw).collect()) == [1, 4, 6]


def test_describe_equals_numpy(spark):
    values = [3, 9, 9, 1, 250, 40, 41]
    df = spark.createDataFrame([("x" * v,) for v in values], f"{NARRATIVE} string")
    row = D.length_describe(df).first().asDict()
    assert row["count"] == 7 and row["mean"] == pytest.approx(statistics.mean(values))
    assert row["std"] == pytest.approx(statistics.stdev(values))
    assert [row[q] for q in ("min", "q25", "q50", "q75", "max")] == list(np.percentile(values, [0, 25, 50, 75, 100]))
    bins = {r["bin"]: r["n_rows"] for r in D.length_histogram(df, bins=50).collect()}
    counts, _ = np.histogram(values, bins=50)
    assert bins == {i: n for i, n in enumerate(counts) if n}


def test_one_value_falls_into_one_bin(spark):
    df = spark.createDataFrame([("abc",), ("xyz",)], f"{NARRATIVE} string")
    assert [tuple(r)[:2] for r in D.length_histogram(df).collect()] == [(0, 2)]


def test_token_lengths(spark):
    sizes = [0, 3, 130, 300, 500]
    df = spark.createDataFrame([("ab " * n,) for n in sizes], f"{NARRATIVE} string")
    stats = {r["metric"]: r["value"] for r in D.token_length_stats(df).collect()}
    assert stats["median"] == 130 and stats["% > 128"] == 60 and stats["% > 384"] == 20
    assert stats["p90"] == pytest.approx(np.percentile(sizes, 90))
    rows = D.token_length_histogram(df).collect()
    assert sum(r["n_rows"] for r in rows) == 5 and {r["least"] for r in rows if not r["shown"]} == {500}


def test_classes(spark):
    sizes = {"a": 1001, "b": 1000, "c": 100, "d": 99}
    df = spark.createDataFrame([(c,) for c, n in sizes.items() for _ in range(n)] + [(None,)] * 2, "category string")
    assert tuple(D.longtail_buckets(df.dropna()).first()) == (1, 2, 1)
    assert [tuple(r) for r in D.longtail_curve(df.dropna()).orderBy("class_rank").collect()][0] == (1, "a", 1001)
    row = D.class_count_describe(df).first()
    assert (row["n_classes"], row["n_missing"], row["max"]) == (4, 2, 1001.0)


def test_top_tokens_head(spark):
    df = spark.createDataFrame([(i, f"word w{chr(97 + i % 3)}") for i in range(30)], f"record_id bigint, {NARRATIVE} string")
    assert [tuple(r) for r in D.top_tokens(df, 1).collect()] == [("word", 30)]


def test_pattern_shares(spark):
    df = spark.createDataFrame([("plain text",), ("XXX-1",), (None,), ("xxx",)], f"{NARRATIVE} string")
    assert tuple(D.pattern_shares(df).first()) == (0.25, 0.25)
