from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from labelloom.llm.topk_search import exact_top_k

SCHEMA = "vec_id long, embedding array<double>, id string, shard string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute(rows, k):
    good = {
        (i, tuple(math.floor(64 * x) for x in v))
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    }
    expected = set()
    for q, a in good:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(b) == len(a))[:k]
            expected |= {(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)}
    return expected


@pytest.mark.parametrize("shard_rows", [40, 1000])
@pytest.mark.parametrize("size", [1.0, 1e7])
def test_equals_brute_force(spark, shard_rows, size):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, size) for _ in range(8)]) for i in range(400)]
    same = [0.5 * size] * 8
    rows += [(400 + i, same) for i in range(150)]  # a third are copies: ties to the smaller id
    rows += [(901, None), (902, []), (903, [1.0, None] * 4), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (None, same)]
    rows += [(920, [1.0, 2.0]), (921, [3.0, 4.0]), rows[3], rows[20]]
    found = exact_top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, k=6, shard_rows=shard_rows)
    assert {tuple(r) for r in found.collect()} == brute(rows, 6)


def test_fewer_candidates_than_k_and_empty_table(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    found = exact_top_k(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 64 * 128)]
    assert exact_top_k(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_search_skips_leaves_below_the_shared_floor():
    import numpy as np

    from labelloom.llm.topk_search import BallTree, Search

    rng = np.random.default_rng(1)
    points = (rng.normal(size=(2000, 4)) * 5).astype(np.int64)
    points[1000:] += 1000
    tree, seen = BallTree(np.arange(2000), points), []

    class Counting(Search):
        def _scan(self, node, who):
            seen.append(node.low)
            super()._scan(node, who)

    Counting(tree, np.array([5000]), np.array([[1, 1, 1, 1]]), np.array([-(2**62)]), 5)
    assert len(seen) <= 9  # only the far cloud's leaves
