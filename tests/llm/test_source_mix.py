from __future__ import annotations

import random

import numpy as np
import pytest

from labelloom.llm.source_mix import mix_sources, repeat_documents
from tests.llm.helpers import docs_frame, words


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        left = total - sum(capped.values())
        share = sum(w for s, w in weight.items() if s not in capped)
        over = [s for s in order if s not in capped and left * weight[s] > most * sizes[s] * share]
        if not over:
            return {s: capped[s] if s in capped else left * weight[s] / share for s in order}
        capped |= {s: most * sizes[s] for s in over}


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "Z", "é", None, "small"][: 5 if i % 50 == 0 else 4])
        rows.append((i, "w " * min(int(rng.expovariate(1 / 60)), 3000), None, source))
    rows += [(1000, None, None, "empty"), (1001, " \n", None, "empty"), (1002, "one", None, "tiny"), (1003, "x " * 20_000, None, "a"), (None, "no id", None, "a"), (5, "repeated id", None, "a"), (5, "repeated id", None, "a")]
    return rows


@pytest.fixture(scope="module")
def mixed(spark):
    return mix_sources(docs_frame(spark, corpus())).collect()


def test_sizes_and_targets(mixed):
    rows, sizes = corpus(), {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    targets = brute_targets(sizes)
    assert len(mixed) == len(rows) and sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-12)


def test_taken_words_come_near_the_targets(mixed):
    taken, target = {}, {}
    for r in mixed:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    for source, t in target.items():
        assert abs(taken[source] - t) <= max(20, 0.02 * t), (source, taken[source], t)


def test_rates_are_exponentially_tilted(mixed):
    """Within a source that is cut down, larger documents are kept less often."""
    hot = [r for r in mixed if r.source == "hot" and r.size > 0]
    assert sum(r.taken for r in hot) < sum(r.size for r in hot)
    cut = np.median([r.size for r in hot])
    small, large = ([r.copies for r in hot if (r.size > cut) == big] for big in (False, True))
    assert np.mean(large) < np.mean(small)


def test_reruns_and_partitions_agree(spark, mixed):
    again = mix_sources(docs_frame(spark, corpus()).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_documents_are_repeated(spark, mixed):
    docs = docs_frame(spark, corpus())
    out = repeat_documents(docs, mix_sources(docs))
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    expected = {}
    for r in mixed:
        expected[r.doc_id] = expected.get(r.doc_id, 0) + r.copies
    assert counts == {i: n for i, n in expected.items() if n}


def test_empty_tables(spark):
    empty = docs_frame(spark, [])
    assert mix_sources(empty).count() == 0 and repeat_documents(empty, mix_sources(empty)).count() == 0
    wordless = docs_frame(spark, [(1, None, None, "a"), (2, "", None, None)])
    assert {(r.doc_id, r.target, r.taken) for r in mix_sources(wordless).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
