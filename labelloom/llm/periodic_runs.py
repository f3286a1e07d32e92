"""Periodic runs of words, found through a dictionary of basic factors.

The dictionary names, for every power of two L, the factors of L words, so that equal factors have equal names. Where
a factor comes again within 2 L words, and again after the same distance d, its occurrences form an arithmetic progression,
which proposes the period d. A run of smallest period q and at least four times that length is proposed at the
L with q <= L < 2 q: its first factor fits three times, and no occurrence lies between, as a word of length L + d
with the periods d < q and q would have a period that divides q. Proposals are extended in both directions by comparing
names from the longest factors down, and told by start and period.

A factor that stands once in its text needs no name, and a longer one that holds it stands once, too; so the
higher levels shrink to the repeated parts of a text. Texts are handled as one sequence of up to ``CHUNK_WORDS``
words (a longer text is one chunk), and separators keep factors from crossing from text to text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_WORDS = 200_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class FactorNames:
    """Names of the factors of 1, 2, 4, ... symbols that occur more than once, and the periods proposed by their distances."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.levels: list[np.ndarray] = []
        self.starts, self.periods = [], []
        alone = -1 - np.arange(n + 1, dtype=np.int64)  # a name of its own for every factor that stands once
        at, keys, size = np.arange(n), symbols, 1
        while len(at):
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            same = keys[1:] == keys[:-1]
            repeated = np.concatenate((same, [False])) | np.concatenate(([False], same))
            names = alone.copy()
            names[at[repeated]] = np.cumsum(np.concatenate(([0], ~same)))[repeated]
            self.levels.append(names)
            self._propose(at[:-1][same], at[1:][same], size, n)
            at = np.sort(at[repeated])
            at = at[at + size < n]
            at = at[names[at + size] >= 0]
            keys = names[at] * (n + 1) + names[at + size]
            size *= 2

    def _propose(self, at: np.ndarray, after: np.ndarray, size: int, n: int) -> None:
        """Start and period of every progression with a distance above size / 2 (lower ones stood a level below) and up to 2 size."""
        distance = np.zeros(n + 1, dtype=np.int64)
        distance[at] = after - at
        at = np.flatnonzero((distance <= 2 * size) & (2 * distance > size))
        at = at[distance[at + distance[at]] == distance[at]]
        proposed = np.zeros(n + 1, dtype=np.int64)
        proposed[at] = distance[at]
        at = at[proposed[at - 1] != proposed[at]]  # neighbours propose the same run; position -1 is the unused last
        self.starts.append(at)
        self.periods.append(distance[at])

    def _equal(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many symbols agree from ``a`` and ``b`` on (step 1), or before them (step -1)."""
        found = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[level], 1 << level
            while True:
                x, y = (a + found, b + found) if step > 0 else (a - found - size, b - found - size)
                equal = (names[np.maximum(x, 0)] == names[np.maximum(y, 0)]) & (x >= 0)
                found += equal * size
                if level < len(self.levels) - 1 or not equal.any():
                    break
        return found

    def runs(self, least: int, times: int) -> np.ndarray:
        """Rows (start, length, period) by start, then period, of all runs of at least ``max(least, times * period)`` symbols."""
        if not self.starts:
            return np.empty((0, 3), dtype=np.int64)
        start, period = np.concatenate(self.starts), np.concatenate(self.periods)
        before = self._equal(start, start + period, -1)
        length = before + period + self._equal(start, start + period, 1)
        found = np.stack([start - before, length, period], axis=1)
        found = found[length >= np.maximum(least, times * period)]
        order = np.lexsort((found[:, 2], found[:, 0]))
        found = found[order]
        return found[np.concatenate(([True], (found[1:] != found[:-1]).any(axis=1)))] if len(found) else found


def _chunks(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    chunk, size = [], 0
    for text in texts:
        words = text.split()
        if chunk and size + len(words) > CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
        chunk.append(words)
        size += len(words)
    if chunk:
        yield chunk


def runs_of_texts(texts: list[list[bytes]], least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of several word lists, which text each belongs to, and which word of the whole sequence a run lets go.

    The sequence holds a separator after each text. Numbers of words are counted from the start of the whole sequence.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds, text = len(flat.dictionary), np.repeat(np.arange(len(texts)), sizes)
    symbols = np.empty(len(codes) + len(texts), dtype=np.int64)
    symbols[np.arange(len(codes)) + text] = codes + text * kinds
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = len(texts) * kinds + np.arange(len(texts))
    found = FactorNames(symbols).runs(least, times)
    edges = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return found, np.searchsorted(ends, found[:, 0]), np.cumsum(edges[:-1]) > 0


def _marking(least: int, times: int):
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            for chunk in _chunks(texts):
                found, owner, gone = runs_of_texts(chunk, least, times)
                sizes = np.array([len(t) for t in chunk], dtype=np.int64)
                first = np.cumsum(sizes + 1) - sizes - 1
                bounds = np.searchsorted(owner, np.arange(len(chunk) + 1))
                kept = [
                    b" ".join(t if bounds[i] == bounds[i + 1] else [w for w, g in zip(t, gone[first[i] :]) if not g]).decode()
                    for i, t in enumerate(chunk)
                ]
                start = found[:, 0] - first[owner]
                runs = pa.StructArray.from_arrays(
                    [pa.array(start), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(chunk)), pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(kept, pa.string()),
                    ],
                    names=[batch.schema.names[0], "n_words", "runs", "collapsed"],
                )
                low += len(chunk)

    return marked


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: the runs of its whole text, and the text with each run's repeats taken out.

    Words are the maximal stretches without space or 0x09-0x0D, case kept, numbered from 0. A run (start, length, period) is a
    stretch with that smallest period and at least ``max(least, times * period)`` words that no neighbouring word
    extends; runs come by start, then period. ``collapsed`` holds, joined by one space, the words that no run contains after its
    first ``period`` words. Null, empty and wordless texts have no run and an empty ``collapsed``. Every row is handled
    by itself, so null and repeated ids stay as they are; other columns are not read and may have any names.
    ``times`` must be at least 4, which the proof above needs.
    """
    if times < 4:
        raise ValueError("times must be at least 4")
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_marking(least, times), f"`{id_col}` {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def strongest_run(runs: Column) -> Column:
    """The run of greatest exact length / period, the first by start and period of equals; null if there is none."""
    return F.reduce(
        runs,
        F.lit(None).cast(RUN),
        lambda best, run: F.when(
            best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
        ).otherwise(best),
    )


def plant_run(text: Column, code: Column) -> Column:
    """Texts whose code is a multiple of 10 become periodic from a word on that the code decides; others stay.

    With g = code // 10 and n words, every word i >= a = g % n becomes word a + (i - a) % p, where
    p = 1 + (n - a) // (3 + g % 8). ``code`` is a non-negative long; a null code changes nothing.
    """

    def planted(t: Column) -> Column:
        words, g = t["words"], t["g"]
        n = F.size(words)
        a = (g % n).cast("int")
        return F.transform(
            F.array(F.struct(words.alias("words"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("int").alias("p"))),
            lambda s: F.array_join(
                F.transform(
                    s["words"],
                    lambda w, i: F.when(i >= s["a"], F.get(s["words"], s["a"] + (i - s["a"]) % s["p"])).otherwise(w),
                ),
                " ",
            ),
        )[0]

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = F.array(F.struct(words.alias("words"), F.floor(code / 10).cast("long").alias("g")))
    changed = F.transform(parts, lambda t: F.when(F.size(t["words"]) > 0, planted(t)))[0]
    return F.when(code % 10 == 0, F.coalesce(changed, text)).otherwise(text)
