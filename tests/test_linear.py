from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import linear as L
from labelloom.scale.staging import StagingScope


def rows(seed, count, terms, classes, most=12):
    """(label, indices, weights) of unit length; some rows are empty, and one class has a third of the rows."""
    rng = random.Random(seed)
    found = []
    for i in range(count):
        label = 0 if i % 3 == 0 else rng.randrange(classes)
        size = 0 if i % 17 == 0 else rng.randrange(1, most)
        own = sorted({min(terms - 1, int(rng.expovariate(1 / 9)) * classes + (label if rng.random() < 0.7 else rng.randrange(classes))) for _ in range(size)})
        raw = np.array([rng.uniform(0.5, 2) for _ in own])
        found.append((label, own, (raw / np.sqrt((raw**2).sum())).tolist() if own else []))
    return found


def frame(spark, data):
    return spark.createDataFrame(data, "label_id int, indices array<int>, weights array<double>").repartition(3)


def dense(data, terms, known=None):
    x = np.zeros((len(data), terms))
    for i, (_, index, weight) in enumerate(data):
        x[i, index] = weight
    if known is not None:
        x = x * known
        norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
        x = x / np.where(norm == 0, 1, norm)
    return x


def gradient(x, y, coef, bias, c, weights):
    """Of the mean objective."""
    w = weights[y]
    k = len(weights)
    z = x @ coef.T + bias
    if k == 2:
        z = np.concatenate([np.zeros_like(z), z], axis=1)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    error = (p - np.eye(k)[y]) * w[:, None] / w.sum()
    if k == 2:
        error = error[:, 1:]
    return error.T @ x + coef / (c * w.sum()), error.sum(axis=0)


def problem_of(classes, c, weights, labels, which):
    weights = np.array(weights)
    return L.Problem(classes, np.array(c), weights, weights[:, labels].sum(axis=1), which)


def cut(monkeypatch, small_parts, broadcast):
    monkeypatch.setattr(L, "BLOCK_DOCS", 40)
    monkeypatch.setattr(L, "BLOCK_ENTRIES", 150)
    if small_parts:
        monkeypatch.setattr(L, "PART_BYTES", 1)
        monkeypatch.setattr(L, "FLUSH_BYTES", 4_000)
    if not broadcast:
        monkeypatch.setattr(L, "MAX_BROADCAST_BYTES", 0)


@pytest.mark.parametrize(("classes", "small_parts", "broadcast"), [(2, False, True), (4, True, False)])
def test_gradient_vanishes_at_the_fit_and_scores_follow(spark, monkeypatch, classes, small_parts, broadcast):
    cut(monkeypatch, small_parts, broadcast)
    terms, tol = 90, 1e-4
    data = rows(classes, 250, terms, classes)
    y = np.array([r[0] for r in data])
    problem = problem_of(classes, [3.0], [np.linspace(0.5, 2, classes)], y, L.Models())
    layout = L.Layout.of(terms, problem.columns)
    assert layout.parts == (6 if small_parts else 1)
    blocks = StagingScope(spark, "t").stage(L.pack(frame(spark, data), layout), "blocks")
    assert blocks.count() > 5
    fit = L.fit(blocks, layout, problem, tol, 400)
    assert fit.converged.all() and fit.gradient[0] <= tol and 3 < fit.steps[0] < 40
    coef, bias = L.coefficients(spark, fit.weights, layout)
    for part in gradient(dense(data, terms), y, coef, bias, 3.0, problem.weights[0]):
        assert np.abs(part).max() <= 2 * tol
    named = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(data)], "block int, label_id int, indices array<int>, weights array<double>, n string")
    got = sorted(L.score(named.drop("label_id").repartition(3), fit.weights, layout, problem.per_model).collect())
    assert [(r["block"], r["n"]) for r in got] == [(i, "x") for i in range(len(data))]
    z = dense(data, terms) @ coef.T + bias
    if classes == 2:
        z = np.concatenate([np.zeros_like(z), z], axis=1)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose([r["proba"] for r in got], p, atol=1e-5)
    assert [r["best"][0] for r in got] == list(np.array([r["proba"] for r in got]).argmax(axis=1))


def test_broadcasts_are_let_go_after_every_step(spark, monkeypatch):
    data, released = rows(3, 60, 20, 2), []
    problem = problem_of(2, [3.0], [np.ones(2)], np.array([r[0] for r in data]), L.Models())
    layout = L.Layout.of(20, problem.columns)
    blocks = StagingScope(spark, "t").stage(L.pack(frame(spark, data), layout), "blocks")
    release = StagingScope.release
    monkeypatch.setattr(StagingScope, "release", lambda scope, *labels: (released.append(labels), release(scope, *labels)))
    assert L.fit(blocks, layout, problem, 1e-9, 3).steps[0] == 3
    assert len(released) >= 3


def test_models_fitted_together_equal_models_fitted_alone(spark, monkeypatch):
    cut(monkeypatch, True, True)
    terms, classes, tol = 60, 3, 3e-4
    data = rows(8, 200, terms, classes)
    y = np.array([r[0] for r in data])
    known = np.array([[True] * 60, [t % 4 != 0 for t in range(60)], [t < 30 for t in range(60)]])
    c, weights = [1.0, 6.0, 2.0], [np.ones(3), np.array([0.4, 1.0, 1.7]), np.ones(3)]
    problem = problem_of(classes, c, weights, y, L.Models(3, (0, 1, 2)))
    layout = L.Layout.of(terms, problem.columns)
    bits = (known * (1 << np.arange(3))[:, None]).sum(axis=0).astype(np.uint64)
    sent = spark.sparkContext.broadcast(bits)
    n = layout.terms
    members = spark.createDataFrame([(p, bytes(bits[p * n : (p + 1) * n])) for p in range(layout.parts)], "part int, data binary")
    scope = StagingScope(spark, "t")
    blocks = scope.stage(L.pack(frame(spark, data), layout, 3, sent), "blocks")
    fit = L.fit(blocks, layout, problem, tol, 400, members)
    assert fit.converged.all() and len(set(fit.steps)) > 1  # each model has steps of its own
    coef, bias = L.coefficients(spark, fit.weights, layout)
    for m in range(3):
        own, b = coef[3 * m : 3 * m + 3], bias[3 * m : 3 * m + 3]
        assert (own[:, ~known[m]] == 0).all()
        parts = gradient(dense(data, terms, known[m]), y, own, b, c[m], np.array(weights[m]))
        assert max(np.abs(parts[0][:, known[m]]).max(), np.abs(parts[1]).max()) <= 2 * tol
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, label_id int, indices array<int>, weights array<double>")
    best = sorted(L.score(numbered.repartition(2), fit.weights, layout, 3, problem.which, sent).collect())
    for m in range(3):
        z = dense(data, terms, known[m]) @ coef[3 * m : 3 * m + 3].T + bias[3 * m : 3 * m + 3]
        assert [r["best"][m] for r in best] == list(z.argmax(axis=1))
    # Some models go on from where a short fit left them, over the same blocks.
    short = L.fit(blocks, layout, problem, tol, 3, members)
    assert (short.steps == 3).all() and not short.converged.any()
    some = problem.pick([0, 2])
    less = L.Layout(terms, some.columns, layout.terms)
    more = L.fit(blocks, less, some, tol, 400, members, L.pick_models(short.weights, layout, 3, [0, 2]))
    again, _ = L.coefficients(spark, more.weights, less)
    assert more.converged.all()
    assert np.allclose(again[:3], coef[:3], atol=0.3) and np.allclose(again[3:], coef[6:], atol=0.3)


def test_a_fit_that_starts_at_its_end_takes_no_step(spark):
    data = rows(3, 90, 30, 3)
    y = np.array([r[0] for r in data])
    problem = problem_of(3, [1.0], [np.ones(3)], y, L.Models())
    layout = L.Layout.of(30, 3)
    blocks = StagingScope(spark, "t").stage(L.pack(frame(spark, data), layout), "blocks")
    fit = L.fit(blocks, layout, problem, 1e-3, 300)
    again = L.fit(blocks, layout, problem, 1.01e-3, 300, None, fit.weights)
    assert again.steps[0] == 0 and again.converged.all()


def test_a_step_writes_one_row_a_part_whatever_the_rows(spark, monkeypatch):
    cut(monkeypatch, True, True)
    data = rows(5, 250, 30, 3)
    y = np.array([r[0] for r in data])
    problem = problem_of(3, [1.0], [np.ones(3)], y, L.Models())
    layout = L.Layout.of(30, 3)
    blocks = StagingScope(spark, "t").stage(L.pack(frame(spark, data), layout), "blocks")
    written, plain = [], StagingScope.stage

    def stage(self, df, label):
        written.append(plain(self, df, label).count())
        return spark.read.schema(df.schema).parquet(f"{self.folder}/{label}")

    monkeypatch.setattr(StagingScope, "stage", stage)
    fit = L.fit(blocks, layout, problem, 1e-3, 6)
    assert blocks.count() > layout.parts + 1 and fit.steps[0] > 1
    assert set(written) == {layout.parts + 1}


def test_a_step_takes_one_pass_over_the_rows_and_steps_are_few(spark, monkeypatch):
    cut(monkeypatch, True, True)
    data = rows(6, 250, 60, 4)
    y = np.array([r[0] for r in data])
    problem = problem_of(4, [3.0], [np.linspace(0.5, 2, 4)], y, L.Models())
    layout = L.Layout.of(60, 4)
    blocks = StagingScope(spark, "t").stage(L.pack(frame(spark, data), layout), "blocks")
    passes, plain = [], L._joined

    def joined(blocks, vectors, layout, carry):
        passes.append(len(vectors.columns) - 1)
        return plain(blocks, vectors, layout, carry)

    monkeypatch.setattr(L, "_joined", joined)
    fit = L.fit(blocks, layout, problem, 1e-3, 100)
    assert fit.converged.all() and sum(passes) <= 1.5 * fit.steps[0]  # products of the rows with a vector
    zero = L.fit(blocks, layout, problem, 1e-3, 0)
    assert fit.loss[0] < zero.loss[0] and np.isclose(zero.loss[0], np.log(4))


def test_sparse_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    key = np.sort(np.minimum(rng.geometric(0.03, 4_000), 300) - 1)
    source, value, table = rng.integers(0, 50, 4_000), rng.random(4_000), rng.random((50, 7))
    plain, found = np.zeros((300, 7)), np.zeros((300, 7))
    np.add.at(plain, key, value[:, None] * table[source])
    L._add_products(found, key, source, value, table)
    assert np.allclose(found, plain, atol=1e-10)


def test_extreme_margins_do_not_overflow():
    p, log_total = L.softmax(np.array([[1000.0, -1000.0], [0.0, 0.0]]))
    assert np.allclose(p, [[1, 0], [0, 1]]) and np.allclose(log_total, [1000, 0])


@pytest.mark.parametrize("held", [True, False])
def test_a_held_state_takes_the_same_steps_and_writes_no_table(spark, monkeypatch, held):
    """Steps of small vectors write nothing; the fit is that of the state kept in tables."""
    cut(monkeypatch, True, True)
    data = rows(11, 250, 90, 4)
    y = np.array([r[0] for r in data])
    problem = problem_of(4, [3.0], [np.linspace(0.5, 2, 4)], y, L.Models())
    layout = L.Layout.of(90, problem.columns)
    blocks = StagingScope(spark, "t").stage(L.pack(frame(spark, data), layout), "blocks")
    monkeypatch.setattr(L, "HELD_BYTES", L.HELD_BYTES if held else 0)
    written = []
    stage = StagingScope.stage
    monkeypatch.setattr(StagingScope, "stage", lambda scope, df, label: written.append(label) or stage(scope, df, label))
    fit = L.fit(blocks, layout, problem, 1e-4, 400)
    assert (set(written) == {"weights"}) is held
    coef, bias = L.coefficients(spark, fit.weights, layout)
    slope = gradient(dense(data, 90), y, coef, bias, 3.0, problem.weights[0])
    assert fit.converged.all() and max(abs(slope[0]).max(), abs(slope[1]).max()) <= 1.1e-4
    again = L.fit(blocks, layout, problem, 1e-4, 400, start=fit.weights)
    assert again.steps[0] == 0 and np.allclose(L.coefficients(spark, again.weights, layout)[0], coef)


def test_blocks_are_dealt_out_evenly(spark, monkeypatch):
    cut(monkeypatch, False, True)
    data = rows(12, 640, 90, 3)
    layout = L.Layout.of(90, 3)
    blocks = StagingScope(spark, "t").stage(L.pack(frame(spark, data), layout), "blocks")
    dealt = L.placed(blocks)
    held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    dealt.unpersist()
    assert len(held) == 8 and sum(held) == blocks.count() and max(held) - min(held) <= 1


def test_a_start_is_cleared_of_terms_a_model_does_not_know(spark, monkeypatch):
    """Two models, one of which knows half the terms, begun from the other's coefficients; in tables and held."""
    cut(monkeypatch, True, True)
    terms, tol = 60, 1e-4
    data = rows(13, 200, terms, 3)
    y = np.array([r[0] for r in data])
    bits = np.where(np.arange(terms) % 2 == 0, 3, 1).astype(np.uint64)
    problem = problem_of(3, [2.0, 2.0], [[1.0] * 3] * 2, y, L.Models(2, (0, 1)))
    layout = L.Layout.of(terms, problem.columns)
    blocks = StagingScope(spark, "t").stage(L.pack(frame(spark, data), layout, 2, spark.sparkContext.broadcast(bits), precision=np.float32), "blocks")
    parts = [(p, bytes(bits[p * layout.terms : (p + 1) * layout.terms])) for p in range(layout.parts)]
    members = spark.createDataFrame(parts, "part int, data binary")
    both = L.fit(blocks, layout, problem, tol, 400, members)
    one = problem.pick([1])
    begun = L.pick_models(both.weights, layout, 3, [0])
    for held in (True, False):
        monkeypatch.setattr(L, "HELD_BYTES", (32 << 20) if held else 0)
        fit = L.fit(blocks, L.Layout(terms, 3, layout.terms), one, tol, 400, members, begun)
        coef, bias = L.coefficients(spark, fit.weights, fit.layout)
        assert fit.converged.all() and (coef[:, 1::2] == 0).all()
        slope = gradient(dense(data, terms, bits > 1), y, coef, bias, 2.0, problem.weights[1])
        assert max(abs(slope[0][:, ::2]).max(), abs(slope[1]).max()) <= 1.1 * tol
