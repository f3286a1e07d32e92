from __future__ import annotations

import random

import numpy as np
import pytest

from labelloom.llm.jaccard_join import PartEnum, first_of_groups, jaccard_components
from labelloom.llm.shingles import parity_sketch
from tests.llm.helpers import docs_frame, edited, linked_groups, shingles


@pytest.mark.parametrize(("num", "den", "parts", "lost"), [(9, 10, 2, 1), (8, 10, 2, 1), (8, 10, 3, 1), (9, 10, 4, 2)])
def test_similar_sets_share_a_signature(num, den, parts, lost):
    rng = np.random.default_rng(5)
    enum = PartEnum(num, den, parts, lost)
    for _ in range(400):
        n = int(rng.integers(2, 400))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        drop = int(rng.integers(0, n // 6 + 1))
        other = np.concatenate([base[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)])
        both, union = n - drop, n + len(other) - (n - drop)
        if both * den >= union * num and union > both:
            assert set(enum.signatures(base)) & set(enum.signatures(other))
            apart = int(np.bitwise_count((parity_sketch(base) ^ parity_sketch(other)).view(np.uint64)).sum())
            assert apart <= union - both


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, number = [], 0
    for _ in range(12):
        base = " ".join(rng.choices(vocabulary, k=rng.randint(30, 260)))
        for copy in range(rng.randint(1, 7)):
            rows.append((number, base if copy == 0 else edited(base, rng.choice([37, 60, 90, 150]), copy)))
            number += 1
    rows += [(number + i, t) for i, t in enumerate(["", None, "  \n ", "one", "One", "two words", "TWO\twords", "a b c", "a b d"])]
    rows.append((number + 20, " ".join(rng.choices(vocabulary, k=30_000))))
    rows.append((number + 21, rows[-1][1] + " tail"))
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    for num, den, width in ((90, 100, 3), (80, 100, 5)):
        sets = {i: shingles(t, width) for i, t in rows}
        groups = linked_groups(sets, num, den)
        found = jaccard_components(docs_frame(spark, rows), num, den, width).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {(i, len(sets[i]), groups[i]) for i in sets}


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(1)
    base = " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(120))
    rows = [(i, edited(base, 121 if i % 2 else 60 + i % 40, i % 50)) for i in range(300)]
    sets = {i: shingles(t, 3) for i, t in rows}
    groups = linked_groups(sets, 90, 100)
    found = jaccard_components(docs_frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == groups


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "p q r s"), (9, "A  b c d"), (7, "x y z u"), (8, "x y z u")]
    found = jaccard_components(docs_frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (5, 5), (5, 5), (7, 7), (7, 7), (8, 7), (9, 5)]


def test_empty_table(spark):
    empty = docs_frame(spark, [])
    assert jaccard_components(empty).columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard_components(empty).count() == 0 and first_of_groups(empty, 8, 10, 5).count() == 0


def test_first_of_groups_keeps_one_row_and_all_columns(spark):
    rows = corpus(4)
    frame = docs_frame(spark, rows)
    kept = first_of_groups(frame, 80, 100, 5)
    assert kept.columns == frame.columns
    groups = linked_groups({i: shingles(t, 5) for i, t in rows}, 80, 100)
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == sorted(set(groups.values()))
    assert {r["key"] for r in got} == {"y"} and {r["_key"] for r in got} == {"z"}


def test_first_of_groups_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (6, "k l m n o p"), (6, "k l m n o p"), (None, ""), (None, ""), (4, None)]
    kept = first_of_groups(docs_frame(spark, rows), 80, 100, 5).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == [(0, ""), (0, "a b c d e f"), (4, ""), (6, "k l m n o p")]


def test_sketches_grow_with_their_sets_and_lose_no_link():
    import pyarrow as pa

    from labelloom.llm import linking

    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 50_000, 9_000)]
    close = [w if i % 200 else "other" for i, w in enumerate(base)] + [f"x{i}" for i in range(300)]
    strange = [f"v{i}" for i in rng.integers(0, 50_000, 8_000)]
    texts = [" ".join(base), " ".join(close), " ".join(strange), "a few words that stand in no other text", ""]
    batch = pa.record_batch([pa.array(range(5)), pa.array(texts)], names=["node", "text"])
    made = next(linking._sketching(5)(iter([batch]))).to_pydict()
    assert [len(s) * 8 for s in made["sketch"]] == [16_384, 16_384, 8_192, 1_024, 1_024]
    pairs = [(0, 1), (0, 2), (1, 2), (0, 3), (0, 0)]
    rows = {"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}
    rows |= {f"{c}_{side}": [made[c][i] for i in rows[side]] for c in ("n", "sketch") for side in "ab"}
    order = ["a", "b", "n_a", "n_b", "sketch_a", "sketch_b"]
    got = next(linking._near(80, 100)(iter([pa.record_batch([pa.array(rows[c]) for c in order], names=order)])))
    assert list(zip(*got.to_pydict().values())) == [(0, 1), (0, 0)]
