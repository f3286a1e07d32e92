from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from labelloom.llm import periodic_runs as P
from tests.llm.helpers import docs_frame


def brute(words, least=6, times=4):
    """Runs by trying every period at every place."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                own = words[i : i + length]
                if not any(all(own[k] == own[k + r] for k in range(length - r)) for r in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i) + 1
    return sorted((s, l, q) for s, l, q in found)


def collapsed(words, runs):
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def texts(rng, count):
    for _ in range(count):
        size = rng.choice([0, 1, 3, 6, 7, 20, 60, 150])
        kinds = rng.choice([1, 2, 2, 3, 30])
        words = [f"w{rng.randrange(kinds)}" for _ in range(size)]
        for _ in range(rng.randrange(3)):
            at, unit = rng.randrange(len(words) + 1), [f"u{rng.randrange(3)}" for _ in range(rng.randrange(1, 12))]
            words[at:at] = (unit * rng.randrange(2, 9))[: rng.randrange(1, 60)]
        yield words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_WORDS", 300)
    rng = random.Random(seed)
    lists = [[w.encode() for w in t] for t in texts(rng, 150)]
    low = 0
    for chunk in P._chunks([b" ".join(t) for t in lists]):
        found, owner, gone = P.runs_of_texts(chunk, 6, 4)
        first = 0
        for i, words in enumerate(chunk):
            own = [(int(s) - first, int(l), int(q)) for (s, l, q), o in zip(found, owner) if o == i]
            assert own == brute(words)
            kept = b" ".join(w for w, g in zip(words, gone[first:]) if not g)
            assert kept == collapsed(words, own)
            first += len(words) + 1
        assert chunk == lists[low : low + len(chunk)]
        low += len(chunk)
    assert low == len(lists)


def test_operator_on_awkward_rows(spark):
    long = " ".join(["lorem ipsum dolor"] * 30_000)
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "a a a a a"), (5, "a a a a a a"), (6, "A a A a A a A a"), (7, "x y x y x y x y x z"),
        (None, "q q q q q q"), (8, long), (9, "           "), (6, "A a A a A a A a"),
    ]
    out = P.periodic_runs(docs_frame(spark, rows).repartition(3))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=lambda r: (r[0] or 0, r[1]))
    assert got == [
        (None, 6, [(0, 6, 1)], "q"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 5, [], "a a a a a"), (5, 6, [(0, 6, 1)], "a"),
        (6, 8, [(0, 8, 2)], "A a"), (6, 8, [(0, 8, 2)], "A a"), (7, 10, [(0, 9, 2)], "x y z"), (8, 90_000, [(0, 90_000, 3)], "lorem ipsum dolor"),
        (9, 6, [(0, 6, 1)], " "),
    ]
    assert P.periodic_runs(docs_frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(docs_frame(spark, []), times=3)


def test_strongest_run_is_exact_and_breaks_ties_by_start(spark):
    runs = [[(0, 9, 2), (9, 14, 3), (30, 18, 4)], [(5, 8, 2), (20, 12, 3)], []]
    df = spark.createDataFrame([(r,) for r in runs], f"runs array<{P.RUN}>")
    assert [tuple(r[0]) if r[0] else None for r in df.select(P.strongest_run(F.col("runs"))).collect()] == [(9, 14, 3), (5, 8, 2), None]


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len((text or "").encode().split())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark):
    from labelloom.llm.queries import QUERIES

    source = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(source)
    short = [r for r in found if len(source[r.doc_id]) < 20_000]
    assert len(short) > 0.9 * len(found) and sum(r.n_runs > 0 for r in short) > 5
    for r in short:
        words = planted(r.doc_id, source[r.doc_id])
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs)).hexdigest()
