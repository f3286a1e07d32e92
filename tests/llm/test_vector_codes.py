from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from labelloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, id string, ints string, code string, error string, key string, held string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA)


def brute(rows, parts, entries, rounds, scale):
    good = [
        (i, [math.floor(scale * x) for x in v], label)
        for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    width = len(good[0][1]) // parts

    def part(v, p):
        return v[p * width : (p + 1) * width]

    books = [[part(v, p) for _, v, _ in good[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((x - y) ** 2 for x, y in zip(part(v, p), e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = [list(b) for b in books]
        for p in range(parts):
            chosen = [nearest(v, p)[1] for _, v, _ in good]
            for e in range(len(books[p])):
                own = [part(v, p) for (_, v, _), c in zip(good, chosen) if c == e]
                if own:
                    moved[p][e] = [sum(x) // len(own) for x in zip(*own)]
        books = moved
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, label, [nearest(v, p) for p in range(parts)]) for i, v, label in good]
    sums = {}
    for _, label, near in found:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in near)
    return sorted(
        (str(i), "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), sums[label], digest) for i, label, near in found
    )


def told(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


def test_pivots_leave_out_entries_but_never_the_nearest():
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, (40, 3, 4))
    rows = (centres[rng.integers(0, 40, 2000)] + rng.integers(-60, 60, (2000, 3, 4))).astype(np.int64)
    rows[:50] = rows[0]
    entries = np.concatenate([rows[:32], rows[:4], rows[200:228]]).transpose(1, 0, 2)  # repeated entries: ties
    pivots = V.spread_pivots(entries, 4)
    books = V.Codebooks(entries, pivots)
    code, error, tried = books.nearest(rows, V.pivot_distances(rows, pivots))
    squared = ((rows[:, :, None, :] - entries[None]) ** 2).sum(axis=3)
    assert (code == squared.argmin(axis=2)).all() and (error == squared.min(axis=2)).all()
    assert tried < 0.25 * squared.size


@pytest.mark.parametrize("size", [1.0, 4000.0])
@pytest.mark.parametrize("entries", [8, 64])
def test_equals_brute_force(spark, size, entries, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 70)
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, size) for _ in range(8)], rng.choice([None, 1, 2, 3])) for i in range(150, 0, -1)]
    same = [0.25 * size] * 8
    rows += [(300 + i, same, 7) for i in range(90)]  # copies: a third of the rows
    rows += [(901, None, 1), (902, [], 1), (903, [1.0, None] * 4, 1), (904, [float("nan")] * 8, 1), (905, [float("-inf")] * 8, 2)]
    rows += [(None, [-0.001] * 8, None), (None, [3.0] * 8, 1), (906, [1.0, 2.0], 1), rows[3], rows[3], (12, [0.5] * 8, 3)]
    out = V.encode_vectors(frame(spark, rows).repartition(5), 4, entries, 2, 256)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert told(out) == brute(rows, 4, entries, 2, 256)


def test_few_rows_and_errors(spark):
    few = [(5, [1.0, 2.0, 3.0, 4.0], None), (2, [1.5, 2.0, -3.0, 4.0], None)]
    assert told(V.encode_vectors(frame(spark, few), 2, 64)) == brute(few, 2, 64, 2, 256)
    assert V.encode_vectors(frame(spark, []), 2).count() == 0
    assert V.encode_vectors(frame(spark, [(1, None, 1), (2, [], 1)]), 2).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        V.encode_vectors(frame(spark, [(1, [1.0, 2.0, 3.0], 1)]), 2)
    with pytest.raises(ValueError):
        V.encode_vectors(frame(spark, few), 2, 257)
    with pytest.raises(Exception, match="integer component"):
        V.encode_vectors(frame(spark, [(1, [1e300, 2.0], 1)]), 2).collect()
