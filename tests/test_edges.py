"""Values at which a plainer formula would go wrong."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from labelloom.functions import scores as SC
from labelloom.operators import evaluate as E
from labelloom.operators import features as X
from labelloom.operators import profile as D
from labelloom.operators import split as S
from labelloom.scale.joins import pin
from labelloom.sources import writers as W


def test_spread_of_large_values(spark):
    counts = spark.createDataFrame([(10**9 + i, 10**9) for i in range(3)], "value long, n long")
    row = D.describe(counts).first()
    assert row["mean"] == 10**9 + 1 and math.isclose(row["std"], math.sqrt(2 / 3), rel_tol=1e-6)
    single = D.describe(counts.limit(1).withColumn("n", F.lit(1).cast("long"))).first()
    assert single["std"] is None and D.describe(counts.limit(0)).first()["count"] == 0


def test_top_k_of_unknown_labels(spark):
    rows = [([0.1, 0.9], 1), ([0.1, 0.9], 0), ([0.1, 0.9], None), ([0.1, 0.9], 2), ([0.1, None], 1), ([float("nan"), 0.9], 0)]
    frame = spark.createDataFrame(rows, "scores array<double>, label_id int")
    hits = [r[0] for r in frame.select(SC.in_top_k(F.col("scores"), F.col("label_id"), 1)).collect()]
    assert hits == [True, False, None, None, None, True]
    assert E.topk_accuracy(frame, 1).first()[0] == pytest.approx(2 / 6)


@pytest.mark.parametrize("bound", [0, 1000])
def test_encode_null_tokens_on_both_paths(spark, bound):
    docs = spark.createDataFrame([(1, ["a", None, "zz"]), (2, None), (3, [])], "record_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 2, 5), ("b", 3, 4)], "token string, token_id int, freq long")
    rows = X.encode(docs, vocab, max_length=4, min_length=1, max_broadcast_rows=bound).orderBy("record_id").collect()
    assert [r["input_ids"] for r in rows] == [[2, 1, 1, 0], [0] * 4, [0] * 4]
    assert [sum(r["attention_mask"]) for r in rows] == [3, 0, 0]


def test_pin_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for limit in (10, 5000):
        before = seen.value
        table = pin(spark.range(1000).mapInArrow(count, "id long"), "once", max_rows=limit)
        assert table.count() == 1000 and table.agg(F.sum("id")).first()[0] == 499_500
        assert seen.value - before == 1000


def test_metadata_tells_the_length_used(spark):
    rows = [("train", "A"), ("val", "A")]
    frame = spark.createDataFrame(rows, "split string, category string")
    assert W.split_metadata(frame, min_text_length=7).first()["min_text_len"] == 7


def test_unseen_labels_are_counted_in_full(spark):
    rows = [("train", "A")] + [("val", f"new{i:02d}") for i in range(30)]
    with pytest.raises(ValueError, match="30 labels"):
        S.assert_labels_seen(spark.createDataFrame(rows, "split string, category string"))


def test_years_of_typed_and_written_dates(spark):
    rows = [("2020-02-03",), ("2021-01-01",), ("nothing",), (None,)]
    frame = spark.createDataFrame(rows, "day string").withColumn("date", F.try_to_timestamp("day").cast("date"))
    for column in ("day", "date"):
        assert [tuple(r) for r in D.yearly_counts(frame, column).collect()] == [(2020, 1), (2021, 1)]
