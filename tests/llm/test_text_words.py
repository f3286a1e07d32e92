from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash

from labelloom.llm import paragraph_dedup as P
from labelloom.llm import shingles as S

rng = random.Random(5)
TEXTS = [
    None, "", " \t\r\n", "one", "A b\nC  d\n\ne", "é ü　x \ud800 y\n" * 9, "x" * 31 + " " + "y" * 32 + " " + "z" * 90,
    *[" ".join("w" * rng.randint(1, 40) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 90))) for _ in range(40)],
]


def test_words_of_many_texts_have_the_hashes_and_lines_of_each():
    words = S.TextWords(TEXTS)
    parts = np.split(np.arange(len(words.hashes)), np.cumsum(words.lengths)[:-1])
    (start, end), line = words.spans(), words.lines()
    for text, own in zip(TEXTS, parts):
        assert words.hashes[own].tolist() == [xxhash.xxh64_intdigest(w) for w in S.words_of(text)]
        assert line[own].tolist() == [k for k, x in enumerate((text or "").encode("utf-8", "replace").split(b"\n")) for _ in x.split()]
        assert [(text[a:b]).encode("utf-8", "replace").lower() for a, b in zip(start[own], end[own])] == S.words_of(text)


def test_sets_digests_and_sketches_of_many_texts_equal_those_of_each():
    found, sizes = S.TextWords(TEXTS).shingle_sets(5)
    digests, sketches = S.set_digests(found, sizes), S.parity_sketches(found, sizes)
    for text, own, digest, sketch in zip(TEXTS, np.split(found, np.cumsum(sizes)[:-1]), digests, sketches):
        alone = S.shingle_set(S.word_hashes(S.words_of(text), S.WordHashes()), 5)
        assert own.tolist() == alone.tolist()
        assert tuple(digest.tolist()) == S.set_digest(alone) and sketch.tolist() == S.parity_sketch(alone).tolist()


def test_minhash_of_many_sets():
    sets = [np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64) for n in (1, 3, 70)]
    hasher = P.MinHash(4, 3)
    lowest = [(hasher.factors * s[None] + hasher.shifts).min(axis=1).reshape(4, 3) for s in sets]
    expected = [S.mixed((S.mixed(x) * hasher.places).sum(axis=1, dtype=np.uint64) + hasher.salt).tolist() for x in lowest]
    assert hasher.signatures(np.concatenate(sets), np.array([1, 3, 70])).tolist() == expected


def test_anchors_stay_inside_their_stretch():
    hashes = np.array([rng.getrandbits(64) for _ in range(300)], dtype=np.uint64)
    lengths = np.array([0, 30, 4, 5, 200, 61])
    expected, low = [], 0
    for n in lengths.tolist():
        expected += [low + i for i in P.anchors(hashes[low : low + n], 5)]
        low += n
    assert P.anchors(hashes, 5, lengths).tolist() == expected


def test_texts_leave_a_batch_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([None, *["a " * 4 * S.TOGETHER] * 8])], names=["id", "text"])
    slices = list(S.some_texts(batch, 1))
    assert len(slices) == 8 and [i for part, _ in slices for i in part.column(0).to_pylist()] == list(range(9))
