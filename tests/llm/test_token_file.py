from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import token_file as T
from tests.llm.helpers import docs_frame

PATH = T.default_tokenizer()
TEXTS = [
    "Plain words, twice. Plain words, twice.", "", None, "  two  spaces ", "tab\there", "line\nbreak\n\nand  more\n", "it's we're 's ok",
    "<|endoftext|> a <|endoftext|>", "　ideographic space", "a\x1cb \x1c c", "émile ÉCOLE naïve", "no-break space", "nul\0 in\0side",
    "123 456.789, x", "...", " .", ". ", "a\n b", "a \nb", "日本語 テキスト", "🙂 🙂🙂", "x" * 50_000, "word, " * 20_000,
]


def reference(texts):
    tokenizer = T.PieceTokenizer(PATH).tokenizer
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_round_trip(values, a, b):
    ids = np.array(values, dtype=np.uint64)
    words, escapes = T.encode_ids(ids)
    assert (T.decode_ids(words, escapes, len(ids)) == ids).all()
    block = T.pack_block([ids[:a], ids[a:]])
    assert [x.tolist() for x in T.unpack_block(block)] == [ids[:a].tolist(), ids[a:].tolist()]
    low, high = sorted((a, b))
    assert T.unpack_range(block, low, high).tolist() == ids[low:high].tolist()


def test_words_are_packed_tightly():
    assert len(T.encode_ids(np.zeros(480, dtype=np.uint64))[0]) == 2
    assert len(T.encode_ids(np.full(400, 30_000, dtype=np.uint64))[0]) == 100
    assert len(T.encode_ids(np.array([2**63], dtype=np.uint64))[0]) == 2


def test_frames_allow_partial_decoding():
    ids = np.random.default_rng(1).integers(0, 50_000, 20_000).astype(np.uint64)
    assert (T.unpack_range(T.pack_block([ids]), 15_001, 15_900) == ids[15_001:15_900]).all()


@pytest.mark.parametrize("seed", range(3))
def test_pieces_equal_whole_texts(seed):
    rng = np.random.default_rng(seed)
    letters = list("ab'sé, .\n\t1-")
    texts = ["".join(rng.choice(letters, 60)) for _ in range(200)]
    tokenizer = T.PieceTokenizer(PATH)
    assert [x.tolist() for x in tokenizer.encode(texts)] == reference(texts)


def test_cache_generations_change_nothing():
    tokenizer = T.PieceTokenizer(PATH)
    tokenizer.GENERATION = 5
    for text, ids in zip(TEXTS, reference(TEXTS)):
        assert tokenizer.encode([text or ""])[0].tolist() == ids


def digest(rows):
    """Ids ascending, null first."""
    out, start = [], 0
    for (i, _), ids in zip(rows, reference([t for _, t in rows])):
        ids = [*ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_files_equal_brute_force(spark):
    rows = [(None, "no id"), (-3, "negative"), *((2 * i, t) for i, t in enumerate(TEXTS)), (9_000, "same"), (9_000, "same")]
    shuffled = [rows[i] for i in np.random.default_rng(2).permutation(len(rows))]
    got = T.token_file_digest(docs_frame(spark, shuffled)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == digest(rows)


def test_empty_table(spark):
    assert T.token_file_digest(docs_frame(spark, [])).count() == 0


def test_added_tokens_are_as_the_library_has_them():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "plain text", "x<|endoftext|><|endoftext|>\n y", "<|endof text|> <|ENDOFTEXT|>", "", *(t or "" for t in TEXTS)]
    library, own = Tokenizer.from_file(PATH), T.PieceTokenizer(PATH)
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]
