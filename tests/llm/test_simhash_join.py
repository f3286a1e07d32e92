from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from labelloom.llm import simhash_join as S
from labelloom.scale.staging import StagingScope
from tests.llm.helpers import Union, docs_frame, edited


def brute_print(text):
    words = (text or "").encode().lower().split()
    runs = [words[i : i + 4] for i in range(max(1, len(words) - 3))] if words else []
    votes = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(b" ".join(run), 42)
        for i in range(64):
            votes[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * votes[i] > len(runs))


def brute_groups(prints, most=4):
    """Smallest position reachable, over all pairs."""
    union = Union(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                union.join(i, j)
    return [union.find(i) for i in range(len(prints))]


def clustered(rng, count, flips):
    """Fingerprints around few centres, so that many lie within the budget or just outside, and some share long prefixes."""
    centres = [rng.getrandbits(64) for _ in range(max(2, count // 25))]
    found = {0, 1, 15, 31, (1 << 64) - 1, 1 << 63}
    while len(found) < count:
        x = rng.choice(centres)
        for _ in range(rng.randrange(flips + 1)):
            x ^= 1 << rng.choice([rng.randrange(64), rng.randrange(56, 64), rng.randrange(8)])
        found.add(x)
    return sorted(found)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 7])
def test_both_tries_of_a_task_find_all_links(most, monkeypatch):
    monkeypatch.setattr(S, "FRONTIER", 500)
    for seed in range(3):
        prints = clustered(random.Random(seed), 400, 6)
        values = np.array(prints, dtype=np.uint64)
        place, union = {p: i for i, p in enumerate(prints)}, Union(range(len(prints)))
        half = most // 2
        for turned, budget in ((0, half), (32, most - half - 1)):
            if budget < 0:
                continue
            own = np.sort(values << np.uint64(turned) | values >> np.uint64(64 - turned)) if turned else values
            for a, b in zip(*S.joined(own, None, 0, budget, most)):
                a, b = ((int(x) >> turned | int(x) << (64 - turned)) & (1 << 64) - 1 if turned else int(x) for x in (a, b))
                union.join(place[a], place[b])
        assert [union.find(i) for i in range(len(prints))] == brute_groups(prints, most)


@pytest.mark.parametrize("node_rows", [10, 60, 1000])
def test_the_distributed_trie_finds_all_links(spark, node_rows):
    prints = clustered(random.Random(9), 500, 7)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "bits long").repartition(3)
    found = {r.node: r.component for r in S.hamming_components(frame, 4, StagingScope(spark, "t"), node_rows).collect()}
    groups = brute_groups(prints)
    own = [found.get(p, p) for p in signed]
    assert len({(a, b) for a, b in zip(own, groups)}) == len(set(own)) == len(set(groups))


def test_one_prefix_holds_most_fingerprints(spark):
    rng = random.Random(3)
    prints = sorted({0xABCDEF << 40 | rng.getrandbits(14) << 20 | rng.getrandbits(3) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "bits long")
    found = {r.node: r.component for r in S.hamming_components(frame, 4, StagingScope(spark, "t"), 20).collect()}
    own, groups = [found.get(p, p) for p in signed], brute_groups(prints)
    assert len(set(zip(own, groups))) == len(set(own)) == len(set(groups))


def test_operator_on_awkward_rows(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(900))
    rows = [(i, edited(base, 450, i)) for i in range(40)] + [(100 + i, base.upper()) for i in range(40)]
    rows += [(200 + i, " ".join(f"v{rng.randrange(300)}" for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "One Two"), (304, "one  two"), (None, "one two"), (None, "only here by itself now"),
             (305, "x " * 60_000), (306, "x " * 60_001), (7, "another text of a repeated id"), rows[3], (307, "Ünïcode ŽŽ naïve words stay as they are")]
    out = S.simhash_components(docs_frame(spark, rows).repartition(4))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [brute_print(t) for _, t in rows]
    groups = brute_groups(prints)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    expected = sorted((str(i), f"{p:016x}", str(least.get(g))) for (i, _), p, g in zip(rows, prints, groups))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out.collect()) == expected
    assert S.simhash_components(docs_frame(spark, [])).count() == 0
    assert [tuple(r) for r in S.simhash_components(docs_frame(spark, [(4, None)])).collect()] == [(4, "0" * 16, 4)]


def test_text_ids(spark):
    frame = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "quite another")], "name string, body string")
    out = S.simhash_components(frame, id_col="name", text_col="body").collect()
    assert {(r.name, r.component_id) for r in out} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_query_equals_brute_force(spark):
    from labelloom.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in rows]
    groups = brute_groups(prints)
    found = QUERIES["op12_simhash_join"](spark, "/root/testdata/sf0.001").collect()
    assert {tuple(r) for r in found} == {(r.doc_id, f"{p:016x}", rows[g].doc_id) for r, p, g in zip(rows, prints, groups)}
    assert len(found) == len(rows)
