"""Words, shingle sets, set digests and sketches of whole texts, as NumPy arrays inside Arrow batches.

Words are the maximal runs of bytes other than space and 0x09-0x0D, after A-Z became a-z; that is what
``bytes.lower().split()`` does. A shingle is a 64-bit hash of ``width`` consecutive words; a shorter text has
one shingle, its whole sequence; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

MAX_CACHED_WORDS = 500_000
TOGETHER = 1 << 15  # words, or eighths of code points, that are hashed together; one text may have more
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SKETCH_WORDS = 16  # 64-bit words of a parity sketch
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)  # of XXH64
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


class WordHashes(dict):
    """Hash of a word, kept for the words met so far; forgets all when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.array(list(map(cache.__getitem__, words)), dtype=np.uint64)


def hashes_at(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes, as :class:`WordHashes` has them, of the words at these places, without an object a word.

    Words below 32 bytes go through the steps of XXH64 side by side: eight bytes, four bytes and single bytes.
    """
    padded = data + bytes(8)
    eight, four = (np.ndarray(len(data) + 1, kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    p1, p2, p3, p4, p5 = _PRIMES
    total, at = p5 + lengths.astype(np.uint64), starts.copy()
    with np.errstate(over="ignore"):
        for lane in range(3):
            own = np.flatnonzero((lengths >= 8 * lane + 8) & (lengths < 32))
            if not len(own):
                break
            h = total[own] ^ (_turned(eight[at[own]] * p2, 31) * p1)
            total[own] = _turned(h, 27) * p1 + p4
            at[own] += 8
        own = np.flatnonzero(lengths & 4)
        total[own] = _turned(total[own] ^ (four[at[own]].astype(np.uint64) * p1), 23) * p2 + p3
        at[own] += 4
        single = np.frombuffer(padded, np.uint8)
        for left in range(1, 4):
            own = np.flatnonzero((lengths & 3) >= left)
            total[own] = _turned(total[own] ^ (single[at[own]] * p5), 11) * p1
            at[own] += 1
        total = (total ^ (total >> np.uint64(33))) * p2
        total = (total ^ (total >> np.uint64(29))) * p3
        total ^= total >> np.uint64(32)
    for i in np.flatnonzero(lengths >= 32):
        total[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return total


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashes_of(words: list[bytes]) -> np.ndarray:
    """:func:`word_hashes` of many words at a time, with nothing remembered."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return hashes_at(b"".join(words), np.cumsum(lengths) - lengths, lengths)


class TextWords:
    """The words of some texts, one text after another: their hashes, the text of each, and the number of words by text."""

    def __init__(self, texts: list[str | None]) -> None:
        coded = [(t or "").encode("utf-8", "replace").lower() + b"\n" for t in texts]
        data, sizes = b"".join(coded), np.array(list(map(len, coded)), dtype=np.int64)
        self.letters = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[self.letters], prepend=True))  # words begin and end by turns, as a text ends with a line
        self.first, self.after = edge[::2], edge[1::2]
        self.begins = np.cumsum(sizes) - sizes
        self.owner = np.searchsorted(self.begins, self.first, side="right") - 1
        self.lengths = np.bincount(self.owner, minlength=len(texts))
        self.before = np.cumsum(self.lengths) - self.lengths
        self.hashes = hashes_at(data, self.first, self.after - self.first)

    def _counted(self, which: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How many of the bytes ``which`` stand before the places, in their texts."""
        total = np.concatenate([[0], np.cumsum(which)])
        return [total[p] - total[self.begins][self.owner] for p in places]

    def lines(self) -> np.ndarray:
        """Number of the line of every word."""
        return self._counted(self.letters == 10, self.first)[0]

    def spans(self) -> list[np.ndarray]:
        """Start and end of every word in code points."""
        return self._counted((self.letters & 0xC0) != 0x80, self.first, self.after)

    def runs(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of runs of so many words by text, and the places they begin at."""
        runs = np.maximum(self.lengths - run + 1, 0)
        return runs, np.arange(runs.sum()) + np.repeat(self.before - (np.cumsum(runs) - runs), runs)

    def shingle_sets(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        return shingle_sets(self.hashes, self.lengths, width)


def some_texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch, with their texts."""
    texts, held = [], 0
    for i in range(batch.num_rows):
        texts.append(batch.column(column)[i].as_py())
        held += len(texts[-1] or "")
        if held >= 8 * TOGETHER or i == batch.num_rows - 1:
            yield batch.slice(i + 1 - len(texts), len(texts)), texts
            texts, held = [], 0


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sequence(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order."""
    n = len(hashes)
    if n == 0:
        return hashes
    run = min(width, n)
    total = np.full(n - run + 1, run, dtype=np.uint64)
    for i in range(run):
        total += mixed(hashes[i : n - run + 1 + i] + np.uint64(i)) * (_ODD[i % 8] + np.uint64(2 * (i // 8)))
    return mixed(total)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles, ascending."""
    found = np.sort(shingle_sequence(hashes, width))
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def shingle_sets(hashes: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingle_set` of many texts, whose word hashes stand one after another: the sets likewise, and the size of each."""
    lengths = np.asarray(lengths, dtype=np.int64)
    starts, runs = np.cumsum(lengths) - lengths, np.maximum(lengths - width + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), runs)
    found = hashes[:0]
    if len(owner):
        place = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(runs) - runs), runs)
        found = shingle_sequence(hashes, width)[place]  # runs across two texts are left out
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    if len(short):
        found = np.concatenate([found, *[shingle_sequence(hashes[starts[i] : starts[i] + lengths[i]], width) for i in short]])
        owner = np.concatenate([owner, short])
    order = np.argsort(found)
    order = order[np.argsort(owner[order].astype(np.uint16) if len(lengths) <= 1 << 16 else owner[order], kind="stable")]
    found, owner = found[order], owner[order]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[first], np.bincount(owner[first], minlength=len(lengths))


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone, as two signed integers."""
    first = mixed(shingles + _ODD[0]).sum(dtype=np.uint64)
    second = mixed(shingles * _ODD[1] + _ODD[2]).sum(dtype=np.uint64)
    return int(np.int64(first)), int(np.int64(second))


def set_digests(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """:func:`set_digest` of many sets that stand one after another, a row each."""
    found = np.zeros((len(sizes), 2), dtype=np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        starts = (np.cumsum(sizes) - sizes)[filled]
        found[filled, 0] = np.add.reduceat(mixed(shingles + _ODD[0]), starts)
        found[filled, 1] = np.add.reduceat(mixed(shingles * _ODD[1] + _ODD[2]), starts)
    return found.view(np.int64)


def parity_sketch(shingles: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Bit j is the parity of the number of shingles that hash to j; ``words`` (a power of two) has 64 bits each.

    Two sketches differ in at most as many bits as the symmetric difference has members, so a pair whose
    sketches differ in more bits than the threshold allows can be left out without losing a link.
    """
    bits = words * 64
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_sketches(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """:func:`parity_sketch` of many sets that stand one after another, a row each."""
    bits = SKETCH_WORDS * 64
    place = np.repeat(np.arange(len(sizes)) * bits, sizes) + (shingles & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=len(sizes) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), SKETCH_WORDS)
