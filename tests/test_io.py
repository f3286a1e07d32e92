from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from labelloom.operators import model as M
from labelloom.plans import jobs
from labelloom.schema import FINAL_COLUMNS, NARRATIVE
from labelloom.sources import readers as R
from labelloom.sources import writers as W
from tests.conftest import SCHEMA


def test_csv_reader_numbers_rows_in_file_order(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        'product,issue,consumer_complaint_narrative,zipcode\n'
        'a,x,"one, with ""quotes"" and\na line break",01234\n'
        'b,NA,,00001\n'
        'c,y,null,\n'
    )
    rows = R.read_complaints(spark, str(path), "csv").orderBy("record_id").collect()
    assert [r["record_id"] for r in rows] == [0, 1, 2] and rows[0]["zipcode"] == "01234"
    assert rows[0][NARRATIVE] == 'one, with "quotes" and\na line break'
    assert [r[NARRATIVE] for r in rows[1:]] == [None, None] and rows[1]["issue"] is None


def test_readers_name_missing_columns(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("product\na\n")
    with pytest.raises(ValueError, match="consumer_complaint_narrative.*issue"):
        R.read_complaints(spark, str(tmp_path / "raw.csv"), "csv")
    with pytest.raises(ValueError, match="file_format"):
        R.read_complaints(spark, str(tmp_path), "xml")
    spark.createDataFrame([("train",)], "split string").write.parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError, match="category"):
        R.read_split(spark, str(tmp_path / "s"), "train")


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_splits_round_trip_and_are_pruned(spark, tmp_path, file_format):
    rows = [("c0", " t\n\"q\" ", "t", "p", "i", "p|i", "train"), ("c1", "  ", "k", "p", "i", "p|i", "train"),
            ("c2", None, "k", "p", "i", "p|i", "train"), ("c3", "v", "v", "p", "i", "p|i", "val")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*FINAL_COLUMNS, "split"]))
    path = str(tmp_path / "splits")
    W.write_splits(df, path, file_format)
    train = R.read_split(spark, path, "train", file_format=file_format)
    strict = R.read_split_strict(spark, path, "train", file_format=file_format)
    assert {r["complaint_id"] for r in train.collect()} >= {"c0"} and "c2" not in {r["complaint_id"] for r in train.collect()}
    assert [r[NARRATIVE] for r in strict.collect()] == ['t\n"q"']
    if file_format == "parquet":
        plan = train._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(split" in plan and "IsNotNull(consumer_complaint_narrative)" in plan


def test_whole_chain_of_jobs(spark, tmp_path):
    words = {"Loan": "rate bank mortgage", "Card": "fee limit statement", "Debt": "letter call agency", "Rare": "vault key branch"}
    rows = []
    for i in range(150):
        product = list(words)[i % 3] if i % 10 else "Rare"
        own = words[product].split()
        rows.append((i, f"complaint about {own[i % 3]} and {own[i // 3 % 3]} with number {'abcdefghij'[i % 10] * (i + 2)}", product, "Service"))
    raw = spark.createDataFrame(rows, SCHEMA)
    out, report, model = (str(tmp_path / n) for n in ("out", "report", "model"))
    prepared = jobs.prepare_data(raw, out)
    meta = spark.read.json(f"{out}/metadata").first()
    assert meta["split_strategy"] == "stratified_group_kfold_by_text_key" and meta["task"] == "category_only"
    assert meta["train_rows"] + meta["val_rows"] + meta["test_rows"] == 150 == meta["prepare_stats"]["rows_raw"]
    assert meta["columns"] == FINAL_COLUMNS and meta["n_categories_by_split"]["test"] == 4

    stack = M.build_stack("tfidf_lr", {"ngram_range": (1, 1), "max_iter": 50})
    jobs.train_category(spark, out, model, stack, report)
    record = spark.read.json(f"{model}/training_metadata").first()
    assert record["n_labels"] == 4 and record["n_train_rows"] == meta["train_rows"]
    assert jobs.evaluate_category(spark, out, model, report).first()["macro_f1"] > 0.9

    summary = jobs.analyse_tail_errors(spark, out, model, report, threshold=20).first()
    assert summary["worst_classes"] == ["Rare|Service"]
    spark.read.option("header", True).csv(f"{report}/tail_worst_fn_samples").collect()

    jobs.prepare_sequences(spark, out, str(tmp_path / "seq"), max_vocab_size=100, max_length=16)
    seq = spark.read.parquet(str(tmp_path / "seq" / "encoded"))
    assert seq.count() == 150 and seq.filter(F.size("input_ids") != 16).count() == 0
    seq_meta = spark.read.json(str(tmp_path / "seq" / "metadata")).first()
    assert seq_meta["labels"] == sorted(seq_meta["labels"]) and seq_meta["n_labels"] == 4

    fitted = M.load_model(spark, model)
    test = R.read_split(spark, f"{out}/splits", "test")
    scored = M.predict_proba(fitted, test, "record_id", NARRATIVE, ("category",))
    ids = scored.join(fitted.labels, "category").select("record_id", "label_id", F.col("proba").alias("scores"))
    train = R.read_split(spark, f"{out}/splits", "train")
    overall = jobs.analyse_scores(ids, fitted.labels, train, report, head_min=25, mid_min=10, tail_max=9).first()
    assert overall["n_test_samples"] == test.count() and overall["top5_accuracy"] == 1.0
    assert spark.read.option("header", True).csv(f"{report}/confusion_head_top20").count() >= 1

    splits = prepared.split_rows()
    base = {"ngram_range": (1, 1), "max_iter": 5, "max_features": 40}
    best = jobs.tune_category(splits, report, {"one": base, "two": {**base, "c": 8.0}})
    assert jobs.best_settings(best).max_features == 40
    assert json.loads(best.first()["params"])["max_iter"] == 5
