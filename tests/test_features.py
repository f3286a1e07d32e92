from __future__ import annotations

import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators import features as X
from labelloom.scale.joins import lookup_join


def docs(spark, *lists):
    return spark.createDataFrame(list(enumerate(lists)), "record_id bigint, terms array<string>")


CORPUS = [["cat", "dog", "cat"], ["dog", "eel"], ["dog", "fox", "fox", "fox"], []]


def brute_force(corpus, train, min_df=1, max_df=1.0, max_features=None):
    n = len(train)
    df, cf = Counter(t for d in train for t in set(d)), Counter(t for d in train for t in d)
    low, high = (v if isinstance(v, int) else v * n for v in (min_df, max_df))
    kept = sorted((t for t in df if low <= df[t] <= high), key=lambda t: (-cf[t], t))[:max_features]
    vocab = {t: i for i, t in enumerate(sorted(kept))}
    out = []
    for d in corpus:
        raw = {vocab[t]: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(d).items() if t in vocab}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out.append({i: w / norm for i, w in raw.items()})
    return vocab, out


@pytest.mark.parametrize("limits", [{}, {"max_features": 2}, {"min_df": 2}, {"max_df": 2}, {"max_df": 0.5, "max_features": 2}])
@pytest.mark.parametrize("path", [X.tfidf_transform, X.tfidf_by_join])
def test_tfidf_equals_brute_force(spark, limits, path):
    train = docs(spark, *CORPUS)
    vocab = X.fit_vocabulary(X.term_stats(train), 4, **{"min_df": 1, "max_df": 1.0, **limits})
    held_out = [["cat", "cat", "dog", "unknown"], ["unknown"], [], ["fox"]]
    ids, want = brute_force(held_out, CORPUS, **limits)
    assert {r["term"]: r["term_id"] for r in vocab.table.collect()} == ids
    got = {r["record_id"]: dict(zip(r["indices"], r["weights"])) for r in path(docs(spark, *held_out), vocab, "record_id").collect()}
    assert len(got) == 4
    for i, weights in enumerate(want):
        assert got[i] == pytest.approx(weights)


def test_join_path_salts_hot_terms_without_changing_weights(spark):
    many = docs(spark, *[["hot", f"t{i % 9}"] for i in range(200)])
    vocab = X.fit_vocabulary(X.term_stats(many), 200, min_df=1, max_df=1.0)
    narrow = X.tfidf_transform(many, vocab, "record_id")
    joined = X.tfidf_by_join(many, vocab, "record_id", max_broadcast_rows=0, hot_key_rows=50)
    want = {r["record_id"]: r for r in narrow.collect()}
    got = {r["record_id"]: r for r in joined.collect()}
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i]["indices"] == row["indices"] and got[i]["weights"] == pytest.approx(row["weights"])


def test_foreign_terms_are_sifted_before_the_join(spark, monkeypatch):
    vocab = X.fit_vocabulary(X.term_stats(docs(spark, *CORPUS)), 4, min_df=1, max_df=1.0)
    held_out, shuffled = docs(spark, *[["cat", *[f"foreign{i}-{j}" for j in range(50)]] for i in range(40)]), []

    def counted(rows, *args, **more):
        shuffled.append(rows.count())
        return lookup_join(rows, *args, **more)

    monkeypatch.setattr(X, "lookup_join", counted)
    got = X.tfidf_by_join(held_out, vocab, "record_id", max_broadcast_rows=0).collect()
    assert len(got) == 40 and {len(r["indices"]) for r in got} == {1}
    assert 40 <= shuffled[0] < 60  # of 2,040 distinct terms of a row


def test_transform_is_narrow(spark):
    train = docs(spark, *CORPUS)
    vocab = X.fit_vocabulary(X.term_stats(train), 4, min_df=1, max_df=1.0)
    plan = X.tfidf_transform(train, vocab, "record_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan and plan.count("ArrowEvalPython") == 1


def test_uncapped_vocabulary_is_numbered_in_parallel(spark):
    table = X.select_vocab(X.term_stats(docs(spark, *CORPUS)), 4, 1, 1.0, max_features=None)
    assert {r["term"]: r["term_id"] for r in table.collect()} == {"cat": 0, "dog": 1, "eel": 2, "fox": 3}


def test_vocabulary_limits_are_checked(spark):
    stats = X.term_stats(docs(spark, ["a"], ["b"]))
    with pytest.raises(ValueError, match="max_df"):
        X.select_vocab(stats, 2, min_df=3, max_df=0.9)
    with pytest.raises(ValueError, match="no terms"):
        X.fit_vocabulary(stats, 2, min_df=2, max_df=1.0)
    with pytest.raises(ValueError, match="analyzer"):
        X.analyze(F.col("t"), "sentence")


def test_two_short_texts_give_two_rows(spark):
    df = spark.createDataFrame([(0, "credit card issue"), (1, "mortgage payment problem")], "record_id bigint, t string")
    terms = df.select("record_id", X.analyze(F.col("t"), "word", (1, 1)).alias("terms"))
    vocab = X.fit_vocabulary(X.term_stats(terms), 2, min_df=1, max_df=1.0, max_features=100)
    assert vocab.size == 6
    rows = X.to_vectors(X.tfidf_transform(terms, vocab, "record_id"), vocab.size).collect()
    assert len(rows) == 2 and all(r["features"].size == 6 and abs(r["features"].norm(2) - 1) < 1e-12 for r in rows)


def token_docs(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "record_id bigint, t string")
    return df.select("record_id", T.simple_tokenize(F.col("t")).alias("tokens"))


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_encode_and_mask(spark, broadcast_rows):
    vocab = X.build_vocab(token_docs(spark, "credit card issue", "loan payment issue"), 100, 1)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert ids == {"<pad>": 0, "<unk>": 1, "issue": 2, "card": 3, "credit": 4, "loan": 5, "payment": 6}
    out = X.encode(
        token_docs(spark, "credit issue", "unknown token", "", "card " * 9), vocab, 6, min_length=1,
        max_broadcast_rows=broadcast_rows,
    )
    assert dict(out.dtypes)["input_ids"] == "array<int>" and dict(out.dtypes)["attention_mask"] == "array<tinyint>"
    rows = {r["record_id"]: (r["input_ids"], r["attention_mask"]) for r in out.collect()}
    assert rows == {
        0: ([4, 2, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0]),
        1: ([1, 1, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0]),
        2: ([0] * 6, [0] * 6),
        3: ([3] * 6, [1] * 6),
    }


def test_vocab_limits_and_special_tokens(spark):
    tokens = token_docs(spark, "<pad> <unk> b b a a c")
    assert [r["token"] for r in X.build_vocab(tokens, 10, 2).orderBy("token_id").collect()] == ["<pad>", "<unk>", "a", "b"]
    for kwargs in ({"max_size": 9}, {"min_freq": 0}):
        with pytest.raises(ValueError):
            X.build_vocab(tokens, **kwargs)
    with pytest.raises(ValueError):
        X.encode(tokens, X.build_vocab(tokens), 7)


def test_vocab_size_cap_counts_specials(spark):
    tokens = token_docs(spark, " ".join(f"{a}{b}" for a in "abcdef" for b in "uvwxyz"))
    assert X.build_vocab(tokens, 12, 1).count() == 12


def test_oov_stats(spark):
    vocab = X.build_vocab(token_docs(spark, "a a b"), 10, 2)
    df = token_docs(spark, "a b c", "").withColumn("split", F.when(F.col("record_id") == 0, "train").otherwise("val"))
    rows = {r["split"]: tuple(r)[1:] for r in X.oov_stats(df, vocab).collect()}
    assert rows == {"train": (3, 1, 2, pytest.approx(2 / 3)), "val": (0, 0, 0, 0.0)}


def test_labels_round_trip_and_unseen_labels_raise(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "record_id int, category string")
    labels = X.label_index(df)
    assert {r["category"]: r["label_id"] for r in labels.collect()} == {"a": 0, "b": 1}
    encoded = X.encode_labels(df, labels)
    assert sorted(map(tuple, X.decode_labels(encoded.drop("category"), labels).select("record_id", "category").collect())) == sorted(map(tuple, df.collect()))
    other = spark.createDataFrame([(0, "z")], "record_id int, category string")
    with pytest.raises(PySparkException, match="label without an id: z"):
        X.encode_labels(other, labels).collect()
    assert X.encode_labels(other, labels, on_unseen="null").first()["label_id"] is None


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "category string")
    assert {r["category"]: r["weight"] for r in X.balanced_class_weights(df).collect()} == {"a": 8 / 12, "b": 2.0}
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "category string, label_id int")
    got = {r["category"]: r["weight"] for r in X.clipped_class_weights(df, labels, 1.5).collect()}
    raw = {"a": 9 / 18, "b": 9 / 6, "c": 9 / 3}
    mean = sum(raw.values()) / 3
    assert got == pytest.approx({k: min(v / mean, 1.5) for k, v in raw.items()})


def test_a_batch_of_many_terms_is_weighed_in_bounded_memory(spark):
    class Sent:
        value = np.arange(1_000, dtype=np.int64), np.arange(1_000, dtype=np.int32), np.linspace(1.0, 3.0, 1_000)

    weigh = X._weigher(Sent).func
    rng = np.random.default_rng(2)
    lists = pa.array([*[rng.integers(0, 2_000, 4_000) for _ in range(1_000)], None, []], pa.list_(pa.int64()))
    tracemalloc.start()
    got = weigh(lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # 4 million terms
    for i in (0, 999, 1_000, 1_001):
        assert got.slice(i, 1).to_pylist() == weigh(lists.slice(i, 1)).to_pylist()


def test_term_stats_count_repeats_and_sort_nothing(spark):
    docs = spark.createDataFrame([(["b", "a", "b"],), (["a"],), ([],), (None,)], "terms array<string>")
    stats = X.term_stats(docs)
    assert sorted(map(tuple, stats.collect())) == [("a", 2, 2), ("b", 1, 2)]
    assert "sort_array" not in stats._jdf.queryExecution().optimizedPlan().toString()
