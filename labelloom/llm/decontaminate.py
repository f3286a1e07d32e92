"""Benchmark decontamination by spaced-seed hashing.

A document leaks an item if somewhere ``window`` consecutive words of the one lie against ``window`` words of the other,
word for word, with at least num / den of them equal (items shorter than the window are matched in full
length). With m substitutions allowed, the window is cut into m + 2 blocks; a mask keeps two of them and ignores the
other positions. Whatever m positions differ, some mask ignores them all, so hashing the kept words of every
window under every mask and joining the hashes finds every leak; each hit is then verified over the whole window.

Document windows pass a fixed-size bitmap of the benchmark's hashes first, which lets through all true hits and, for
usual benchmarks, little else. It has the same size whatever it holds, so it may be sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.rows import whole_row
from labelloom.llm.shingles import WordHashes, mixed, word_hashes
from labelloom.scale.joins import lookup_join
from labelloom.scale.staging import StagingScope

WINDOW, LEAST_WORDS = 13, 5
BITMAP_BITS = 26
_CHUNK = 500


def lowered(text: str | None) -> list[bytes]:
    """Words of a text in lower case of any alphabet."""
    return text.lower().encode("utf-8", "replace").split() if text else []


class Seeds:
    """The masks of one window length and the hashes of all windows under them."""

    def __init__(self, width: int, num: int, den: int) -> None:
        self.width = width
        self.need = -(-width * num // den)
        blocks = width - self.need + 2
        edges = np.linspace(0, width, min(blocks, width) + 1).round().astype(int)
        self.blocks = [range(a, b) for a, b in zip(edges, edges[1:])]
        self.masks = list(combinations(range(len(self.blocks)), 2)) if len(self.blocks) > 1 else [(0, 0)]
        rng = np.random.default_rng(width)
        self.factors = rng.integers(1, 1 << 62, size=width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, words: np.ndarray) -> list[np.ndarray]:
        """One array per mask: the hash of every window of ``width`` words."""
        n = len(words) - self.width + 1
        sums = []
        for block in self.blocks:
            total = np.zeros(n, dtype=np.uint64)
            for j in block:
                total += words[j : j + n] * self.factors[j]
            sums.append(total)
        salt = np.uint64(self.width << 32)
        return [mixed(sums[a] + (sums[b] << np.uint64(1)) + np.uint64(i) + salt) for i, (a, b) in enumerate(self.masks)]


def _item_rows(window: int, least: int, num: int, den: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seeds = WordHashes(), {}
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                words = word_hashes(lowered(text), cache)
                width = min(window, len(words))
                if width < least:
                    continue
                seed = seeds.setdefault(width, Seeds(width, num, den))
                hashes = np.stack(seed.hashes(words)).view(np.int64)
                places = np.arange(hashes.shape[1])
                tokens = np.lib.stride_tricks.sliding_window_view(words.view(np.int64), width)
                flat = np.tile(tokens, (len(hashes), 1))
                size = hashes.size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.ravel()),
                        pa.array([key.as_py()] * size, batch.column(0).type),
                        pa.array(np.tile(places, len(hashes)).astype(np.int32)),
                        pa.array(np.full(size, width, dtype=np.int32)),
                        pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), width).cast(pa.list_(pa.int64())),
                    ],
                    names=["hash", "key", "item_at", "width", "item_words"],
                )

    return rows


def _document_rows(bitmap: np.ndarray, widths: list[int], num: int, den: int):
    """Windows of documents of which some mask may hit; several documents are hashed as one sequence."""
    schema = pa.schema(
        [("row", pa.int64()), ("doc_at", pa.int32()), ("width", pa.int32()), ("hashes", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int64()))]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        seeds = [Seeds(w, num, den) for w in widths]
        for batch in batches:
            for low in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(low, _CHUNK)
                words = [lowered(t) for t in part.column(1).to_pylist()]
                lengths = np.array(list(map(len, words)))
                joined = word_hashes([w for own in words for w in own], cache)
                starts = np.cumsum(lengths) - lengths
                owner = np.repeat(np.arange(len(lengths)), lengths)
                for seed in seeds:
                    n = len(joined) - seed.width + 1
                    if n <= 0:
                        continue
                    whole = owner[:n] == owner[seed.width - 1 :]
                    hashes = seed.hashes(joined)
                    hits = np.stack([_may_hold(bitmap, h) & whole for h in hashes])
                    at = np.flatnonzero(hits.any(axis=0))
                    if not len(at):
                        continue
                    kept = [[int(h[i]) for h, hit in zip(hashes, hits) if hit[i]] for i in at]
                    signed = joined.view(np.int64)
                    docs = owner[at]
                    found = pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(docs)),
                            pa.array((at - starts[docs]).astype(np.int32)),
                            pa.array(np.full(len(at), seed.width, dtype=np.int32)),
                            pa.array([np.array(k, dtype=np.uint64).view(np.int64) for k in kept], pa.list_(pa.int64())),
                            pa.array([signed[i : i + seed.width] for i in at], pa.list_(pa.int64())),
                        ],
                        names=["id", *schema.names[1:]],
                    )
                    yield found

    return rows


def _may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of a hash are set."""
    mask = np.uint64((1 << BITMAP_BITS) - 1)
    first = hashes & mask
    found = (bitmap[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    some = np.flatnonzero(found)
    second = (hashes[some] >> np.uint64(32)) & mask
    found[some] = (bitmap[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return found


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The two bits of every hash, or-ed together by Spark; at most 2 ** BITMAP_BITS / 64 numbers reach the driver."""
    mask = (1 << BITMAP_BITS) - 1
    place = F.explode(
        F.array(F.col("hash").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(mask)))
    ).alias("place")
    words = (
        hashes.select(place)
        .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    packed = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    packed[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
    return packed.view(np.uint8)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    num: int = 4,
    den: int = 5,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item, n_items, doc_start, doc_end, item_start, matched, width): the longest leak of every (document, item text) pair.

    Words are lower-cased runs without white space. ``doc_start`` and ``doc_end`` bound, in words, the stretch of one
    alignment over which windows match; ``matched`` is the largest number of equal words in a window of ``width``.
    Items of equal words count as one, with the smallest id and their number in ``n_items``; the id
    is null if none of them has one, and items of different words that share an id give a row each. Items of fewer
    than ``least_words`` words, and null or empty texts, match nothing. Rows that repeat an id are reported together. Other columns are not read.
    """
    spark = docs.sparkSession
    scope = StagingScope(spark, "leaks")
    text = F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))
    normal = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    items = (
        benchmark.select(F.col(item_col).alias("item"), text.alias("text"), F.unhex(F.sha2(normal, 256)).alias("key"))
        .groupBy("key")
        .agg(F.min("item").alias("item"), F.count("*").alias("n_items"), F.min("text").alias("text"))
    )
    items = scope.stage(items, "items")
    seeds = scope.stage(
        items.select("key", "text").mapInArrow(
            _item_rows(window, least_words, num, den),
            "hash long, key binary, item_at int, width int, item_words array<long>",
        ),
        "seeds",
    )
    widths = sorted(r["width"] for r in seeds.select("width").distinct().collect())  # at most ``window`` values
    doc_kind = dict(docs.dtypes)[id_col]
    hits = scope.stage(
        docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
            _document_rows(_bitmap(seeds), widths, num, den),
            f"id {doc_kind}, doc_at int, width int, hashes array<long>, doc_words array<long>",
        ),
        "hits",
    )
    probes = hits.select("id", "doc_at", "doc_words", F.explode("hashes").alias("hash"))
    equal = F.size(F.filter(F.zip_with("doc_words", "item_words", lambda a, b: a == b), lambda same: same))
    verified = (
        lookup_join(probes, seeds, "hash")
        .filter(F.size("doc_words") == F.col("width"))
        .withColumn("matched", equal)
        .filter(F.col("matched") * den >= F.col("width") * num)
        .select("id", "key", "doc_at", (F.col("doc_at") - F.col("item_at")).alias("shift"), "width", "matched")
    )
    stretches = verified.groupBy("id", "key", "shift").agg(
        F.min("doc_at").alias("doc_start"),
        F.max(F.col("doc_at") + F.col("width")).alias("doc_end"),
        F.max("matched").alias("matched"),
        F.max("width").alias("width"),
    )
    longest = F.max(
        F.struct(
            (F.col("doc_end") - F.col("doc_start")).alias("length"), "matched", (-F.col("doc_start")).alias("early"),
            "shift", "doc_end", "width",
        )
    )
    best = stretches.groupBy("id", "key").agg(longest.alias("b"))
    return best.join(items.select("key", "item", "n_items"), "key").select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        "n_items",
        (-F.col("b.early")).alias("doc_start"),
        F.col("b.doc_end").alias("doc_end"),
        (-F.col("b.early") - F.col("b.shift")).alias("item_start"),
        F.col("b.matched").alias("matched"),
        F.col("b.width").alias("width"),
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, unchanged. Whether a row leaks depends on its text alone, so texts are told by digest."""
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(key.alias("_key"), F.col(text_col).alias("_text"))
    leaking = find_leaks(keyed, benchmark, id_col="_key", text_col="_text").select("_key").distinct()
    marked = StagingScope(docs.sparkSession, "leaking").stage(leaking.withColumn("_leaks", F.lit(True)), "keys")
    rows = docs.select(whole_row(docs), key.alias("_key"))
    return lookup_join(rows, marked, "_key", "left").filter(F.col("_leaks").isNull()).select("row.*")
