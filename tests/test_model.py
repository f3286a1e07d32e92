from __future__ import annotations

import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import evaluate as E
from labelloom.operators import experiments as EX
from labelloom.operators import features as X
from labelloom.operators import linear as L
from labelloom.operators import model as M
from labelloom.scale.staging import shared_dir
from labelloom.schema import NARRATIVE

WORDS = {"loan": "loan bank rate", "card": "card fee limit", "debt": "debt call letter"}


@pytest.fixture(scope="module")
def splits(spark):
    rows = []
    for i in range(90):
        label = list(WORDS)[i % 3]
        own = WORDS[label].split()
        text = " ".join([own[i % 3], own[(i // 3) % 3], f"noise{i % 4} the".replace(str(i % 4), "abcd"[i % 4])])
        split = ("test", "val", "train", "train", "train")[(i // 3) % 5]
        rows.append((i, text, label, split))
    return spark.createDataFrame(rows, f"record_id bigint, {NARRATIVE} string, category string, split string")


@pytest.fixture(scope="module")
def train(splits):
    return splits.filter("split = 'train'")


def settings(**more):
    return M.build_stack("tfidf_lr", {"min_df": 1, "max_df": 1.0, "ngram_range": (1, 1), "max_iter": 200, **more})


@pytest.fixture(scope="module")
def fitted(train):
    return M.fit_tfidf_lr(train, settings(c=2.0), "record_id", NARRATIVE)


def test_defaults_and_errors():
    assert M.build_stack("tfidf_lr") == M.TextStack(50_000, "word", (1, 2), 2, 0.95, 2.0, "balanced", 1000, 1e-4)
    for name in ("bilstm", "bert", "other"):
        with pytest.raises(ValueError):
            M.build_stack(name)
    for params in ({"analyzer": "sentence"}, {"depth": 3}, {"class_weight": "heavy"}):
        with pytest.raises(ValueError):
            M.build_stack("tfidf_lr", params)


@pytest.mark.parametrize("class_weight", ["balanced", None])
def test_gradient_of_the_summed_objective_vanishes_at_the_fit(spark, splits, class_weight):
    # An uneven training set, so that class weights matter.
    train = splits.filter("split = 'train' and (category <> 'debt' or record_id % 2 = 0)")
    c = 3.0
    fitted = M.fit_tfidf_lr(train, settings(c=c, class_weight=class_weight), "record_id", NARRATIVE)
    arrays = X.tfidf_transform(M.with_terms(train, fitted.stack, NARRATIVE, "record_id", "category"), fitted.vocab, "record_id")
    rows = X.encode_labels(arrays, fitted.labels).collect()
    x = np.zeros((len(rows), fitted.vocab.size))
    for i, r in enumerate(rows):
        x[i, r["indices"]] = r["weights"]
    y = np.array([r["label_id"] for r in rows])
    n_c = np.bincount(y)
    w = len(y) / (3 * n_c[y]) if class_weight else np.ones(len(y))
    coef, bias = fitted.coefficients()
    z = x @ coef.T + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    error = (p - np.eye(3)[y]) * w[:, None]
    assert np.abs(coef + c * error.T @ x).max() < 0.05
    assert np.abs(c * error.sum(axis=0)).max() < 0.05


def test_model_beats_the_majority_and_scores_empty_texts_from_the_intercepts(spark, fitted, splits):
    test = splits.filter("split = 'test'")
    scored = M.predict(fitted, test, "record_id", NARRATIVE, ("category",)).withColumnRenamed("category", "y_true")
    assert E.accuracy(E.confusion_pairs(scored)).first()[0] == 1.0
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "zzz qqq")], f"record_id bigint, {NARRATIVE} string")
    rows = M.predict_proba(fitted, odd, "record_id", NARRATIVE).collect()
    bias = np.exp(fitted.coefficients()[1])
    assert len(rows) == 3
    for r in rows:
        assert r["proba"] == pytest.approx(list(bias / bias.sum()))


def test_two_classes_use_the_binary_objective(splits):
    two = splits.filter("split = 'train' and category <> 'debt'")
    model = M.fit_tfidf_lr(two, settings(), "record_id", NARRATIVE)
    rows = M.predict_proba(model, two, "record_id", NARRATIVE, ("category",)).collect()
    assert len(model.coefficients()[0]) == 1
    assert all(len(r["proba"]) == 2 and r["y_pred"] == r["category"] for r in rows)


def test_one_class_raises(splits):
    with pytest.raises(ValueError, match="two classes"):
        M.fit_tfidf_lr(splits.filter("category = 'debt'"), settings(), "record_id", NARRATIVE)


def test_scoring_starts_no_job_before_it_is_read(spark, fitted, splits):
    spark.sparkContext.setJobGroup("lazy", "scoring")
    scored = M.predict(fitted, splits, "record_id", NARRATIVE)
    tracker = spark.sparkContext.statusTracker()
    assert list(tracker.getJobIdsForGroup("lazy")) == []
    assert scored.count() == 90
    assert list(tracker.getJobIdsForGroup("lazy"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_half_written_and_altered_stores(spark, fitted, splits, tmp_path):
    path = tmp_path / "m"
    M.save_model(fitted, str(path))
    (first,) = path.iterdir()
    (first / "manifest").rename(first / "hidden")
    with pytest.raises(FileNotFoundError):
        M.load_model(spark, str(path))
    M.save_model(fitted, str(path))
    assert len(list(path.iterdir())) == 2
    assert M.load_model(spark, str(path)).stack == fitted.stack  # the whole version counts, whatever lies beside it
    (second,) = [p for p in path.iterdir() if p != first]
    spark.createDataFrame([("x", 0)], "category string, label_id int").write.mode("append").parquet(str(second / "labels"))
    with pytest.raises(ValueError, match="labels"):
        M.load_model(spark, str(path))


def test_stored_model_predicts_the_same(spark, fitted, splits, tmp_path):
    M.save_model(fitted, str(tmp_path / "m"))
    M.save_model(fitted, str(tmp_path / "m"))
    before = M.predict_proba(fitted, splits, "record_id", NARRATIVE).orderBy("record_id").collect()
    after = M.predict_batch(splits, str(tmp_path / "m"), "record_id", NARRATIVE).orderBy("record_id").collect()
    assert before == after and len(after) == 90
    with pytest.raises(FileNotFoundError):
        M.load_model(spark, str(tmp_path / "absent"))
    for kind in ("bilstm", "distilbert", "other"):
        with pytest.raises(ValueError):
            M.predict_batch(splits, str(tmp_path / "m"), "record_id", NARRATIVE, kind)


def test_majority_baseline(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "category string")
    assert {r["y_pred"] for r in M.majority_baseline(train, spark.range(3)).collect()} == {"a"}


# --- experiments -------------------------------------------------------------------


def test_default_grid():
    grid = EX.default_grid()
    assert len(grid) == 18
    assert grid["tfidf_lr_grid_n_m2_d085"] == {
        "max_features": 70_000, "ngram_range": (1, 2), "min_df": 2, "max_df": 0.85, "c": 8.0, "class_weight": None,
    }


def test_leaderboard_and_best(splits):
    base = {"min_df": 1, "max_df": 1.0, "ngram_range": (1, 1), "max_iter": 20}
    board = EX.grid_leaderboard(splits, {"wide": {**base, "max_features": 50}, "narrow": {**base, "max_features": 1}}).collect()
    assert [r["experiment_name"] for r in board] == ["wide", "narrow"]
    assert board[0]["macro_f1"] == 1.0 and board[1]["n_features"] == 1 and board[0]["fit_time_sec"] > 0
    best = EX.best_experiment(splits.sparkSession.createDataFrame(board)).first()
    assert best["experiment_name"] == "wide" and json.loads(best["params"])["max_features"] == 50
    with pytest.raises(ValueError):
        EX.grid_leaderboard(splits, {})


def test_random_search(splits):
    drawn = EX.random_settings(20, 42)
    assert drawn == EX.random_settings(20, 42) != EX.random_settings(20, 43)
    assert all(1.0 <= d["c"] <= 12.0 and d["max_features"] in EX.SEARCH_SPACE["max_features"] for d in drawn)
    space = {"min_df": [1, 2, 80], "max_df": [1.0]}
    args = {"space": space, "base": {"max_iter": 40, "ngram_range": (1, 1)}, "rungs": (1, 3)}
    found = EX.random_search(splits, 12, **args)
    assert found.columns == [
        "trial_number", "state", "macro_f1", "accuracy", "n_features", "fit_time_sec", "rung", "message",
        "param_max_features", "param_min_df", "param_max_df", "param_class_weight", "param_c",
    ]
    trials = found.collect()
    order = {"COMPLETE": 0, "PRUNED": 1, "FAIL": 2}
    states = [order[r["state"]] for r in trials]
    assert states == sorted(states) and set(states) == {0, 1, 2}
    assert all((r["macro_f1"] is None) == (r["state"] == "FAIL") == (r["param_min_df"] == 80) for r in trials)
    assert all((r["message"] is None) == (r["state"] != "FAIL") for r in trials)
    tried = [r for r in trials if r["state"] != "FAIL"]
    by_rung = [sum(r["rung"] >= k for r in tried) for k in range(3)]
    assert by_rung[0] == len(tried) and by_rung[0] > by_rung[1] >= by_rung[2] >= 1
    done = [r for r in trials if r["state"] == "COMPLETE"]
    assert all(r["rung"] == 2 for r in done)
    best = EX.best_trial(found).first()
    assert best["trial_number"] == done[0]["trial_number"]
    again = EX.random_search(splits, 12, **args).collect()
    same = ("trial_number", "state", "macro_f1", "accuracy", "n_features", "rung")
    assert [[r[k] for k in same] for r in again] == [[r[k] for k in same] for r in trials]
    late = EX.random_search(splits, 3, timeout_sec=0).collect()
    assert [r["state"] for r in late] == ["NOT_RUN"] * 3


def test_search_stores_the_coefficients_of_the_best_third_alone(splits, monkeypatch):
    folder = Path(shared_dir(splits.sparkSession).removeprefix("file:"))
    there, held, plain = set(folder.glob("coefficients-*")), [], L.fit

    def stored():
        return len(set(folder.glob("coefficients-*")) - there)

    monkeypatch.setattr(L, "GROUP_BYTES", 1)
    monkeypatch.setattr(L, "fit", lambda *args: held.append(stored()) or plain(*args))
    args = {"space": {"min_df": [1, 2], "max_df": [1.0]}, "base": {"max_iter": 4, "ngram_range": (1, 1)}, "rungs": (1,)}
    trials = EX.random_search(splits, 6, **args).collect()
    assert sorted(r["state"] for r in trials) == ["COMPLETE"] * 2 + ["PRUNED"] * 4
    assert len(held) == 8 and 2 <= max(held) <= 3 and stored() == 0  # two that go on, and one of them fitted further


def test_models_in_groups_end_where_models_together_do(splits, monkeypatch):
    args = {"space": {"min_df": [1, 2], "max_df": [1.0]}, "base": {"max_iter": 60, "ngram_range": (1, 1)}, "rungs": (2,)}
    told = ("trial_number", "state", "macro_f1", "accuracy", "n_features", "rung")
    together = [[r[k] for k in told] for r in EX.random_search(splits, 5, **args).collect()]
    vectors, plain = [], L.fit
    monkeypatch.setattr(L, "GROUP_BYTES", 1)
    monkeypatch.setattr(L, "fit", lambda blocks, layout, *more: vectors.append(layout.columns) or plain(blocks, layout, *more))
    assert [[r[k] for k in told] for r in EX.random_search(splits, 5, **args).collect()] == together
    assert set(vectors) == {3} and len(vectors) > 2  # one model of three classes at a time


def test_bad_settings_are_not_a_failed_trial(splits):
    with pytest.raises(ValueError, match="analyzer"):
        EX.random_search(splits, 1, base={"analyzer": "letters"})


def test_equal_settings_are_told_by_name(splits):
    rows = [("b", 0.5, 0.7), ("a", 0.5, 0.7), ("c", 0.4, 0.7)]
    table = splits.sparkSession.createDataFrame(rows, "config string, test_macro_f1 double, test_weighted_f1 double")
    for parts in (1, 3):
        assert tuple(EX.best_ablation(table.repartition(parts)).first()) == ("a", "a")


def test_ablation(splits):
    table = EX.vectorizer_ablation(splits, max_iter=10, max_features=200).collect()
    assert {r["config"] for r in table} == set(EX.ABLATION)
    scores = [r["test_macro_f1"] for r in table]
    assert scores == sorted(scores, reverse=True)
    best = EX.best_ablation(splits.sparkSession.createDataFrame(table)).first()
    assert best["best_by_test_macro_f1"] in EX.ABLATION


def test_model_comparison_reads_records_by_path(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"category_macro_f1": 0.5}))
    (tmp_path / "b.json").write_text(json.dumps({"test": {"accuracy": 0.4, "macro_f1": 0.2, "weighted_f1": 0.3}}, indent=2))
    (tmp_path / "c.json").write_text(json.dumps({"accuracy": 0.6, "macro_f1": 0.25}))
    (tmp_path / "d.json").write_text(json.dumps({"val": {}}))

    def record(name, *path):
        return EX.metrics_record(spark, str(tmp_path / f"{name}.json"), name, f"{name}.json", "cfg", path)

    rows = EX.compare_records([record("a"), record("b", "test"), record("c"), record("d", "test"), record("absent")]).collect()
    assert [r["model_name"] for r in rows] == ["c", "b", "a"]
    assert rows[0]["weighted_f1"] is None and rows[2]["macro_f1"] is None and rows[1]["accuracy"] == 0.4
    with pytest.raises(ValueError):
        EX.compare_records([None])
    nan = spark.createDataFrame([("n", "s", "", 1.0, math.nan, 1.0)], "model_name string, source string, config_summary string, accuracy double, macro_f1 double, weighted_f1 double")
    assert EX.compare_records([record("b", "test"), nan]).collect()[-1]["macro_f1"] is None


def test_a_later_group_begins_at_the_nearest_models_and_ends_by_its_gradient(splits, monkeypatch):
    """Settings that differ in min_df alone, a model a group: the second needs fewer steps, and fits its own vocabulary."""
    stacks = [settings(c=c, min_df=low, class_weight=w) for low, c, w in ((1, 4.0, "balanced"), (14, 4.0, "balanced"), (14, 4.0, None), (14, 2.0, None))]
    found = {}
    for size in (L.GROUP_BYTES, 1):
        monkeypatch.setattr(L, "GROUP_BYTES", size)
        shared = EX._Splits(splits, NARRATIVE, stacks[0])
        table = shared.table(stacks)
        joint = table.fit()
        assert table.together == (len(set(joint.distinct)) if size > 1 else 1)
        found[size] = [joint.ended(i) for i in range(len(stacks))], shared.metrics(joint, "val", "test")
        if size == 1:
            assert table._nearest([joint.distinct[1]], [joint.distinct[0]]) == [joint.distinct[0]]
            assert table._nearest([joint.distinct[2]], [joint.distinct[0], joint.distinct[1]]) in ([], [joint.distinct[0]], [joint.distinct[1]])
        joint.clear()
        table.clear()
    whole, single = found.values()
    assert all(c for _, _, c in whole[0] + single[0]) and max(g for _, g, _ in single[0]) <= 1e-4
    assert single[0][1][0] < whole[0][1][0]
    assert single[1] == whole[1]
