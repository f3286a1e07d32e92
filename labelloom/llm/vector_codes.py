"""Vector codes by part-wise codebooks (product quantisation), assigned with LAESA pivots in exact integers.

A vector is cut into equal parts, and a part is coded by the nearest of a few entries of the codebook of its position. The
distances of every part to a few fixed pivots are computed once and stored beside the vectors. In each round only
the distances pivot-entry are new, and few. By the triangle inequality the difference of the two is a lower bound of
the distance part-entry. A part tries entries by rising bound, each in exact integers, and stops where the next bound
exceeds its best distance; entries at the bound are still tried, since of equal distances the lower index wins.

Bounds are floats with a margin above their rounding error, so they only ever leave out entries that are truly
further away. Codebooks are small and fixed in size (parts x entries); a task sums its parts per entry before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.scale.joins import lookup_join
from labelloom.scale.staging import StagingScope

BLOCK_ROWS = 4_096
LARGEST = 1 << 28  # of an integer component; squared distances then stay exact in 64 bits for parts of up to 32
MARGIN = 1e-9  # relative; a distance below 2**32 is off by some 1e-16 of itself


class Codebooks:
    """Entries (parts, entries, width) of one round with their distances to the pivots (parts, pivots, width)."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray) -> None:
        self.entries, self.pivots = entries, pivots
        self.to_pivots = pivot_distances(entries.transpose(1, 0, 2), pivots).transpose(1, 2, 0)

    def nearest(self, parts: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of every part, and how many exact distances that took.

        ``parts`` is (rows, parts, width) in integers, ``distances`` (rows, parts, pivots) from :func:`pivot_distances`.
        """
        rows, count, _ = parts.shape
        code, error, tried = np.empty((rows, count), np.int64), np.empty((rows, count), np.int64), 0
        for p in range(count):
            own, entries = parts[:, p], self.entries[p]
            bound = np.zeros((rows, len(entries)))
            for k in range(self.pivots.shape[1]):
                np.maximum(bound, np.abs(distances[:, p, k, None] - self.to_pivots[p, k]), out=bound)
            slack = MARGIN * (1 + distances[:, p].max(axis=1) + self.to_pivots[p].max())
            best = np.full(rows, np.iinfo(np.int64).max)
            index = np.zeros(rows, np.int64)
            at = np.arange(rows)
            while len(at):
                tried += len(at)
                entry = bound[at, :].argmin(axis=1)
                squared = ((own[at] - entries[entry]) ** 2).sum(axis=1)
                better = (squared < best[at]) | ((squared == best[at]) & (entry < index[at]))
                best[at[better]], index[at[better]] = squared[better], entry[better]
                bound[at, entry] = np.inf
                at = at[bound[at].min(axis=1) <= np.sqrt(best[at]) + slack[at]]
            code[:, p], error[:, p] = index, best
        return code, error, tried


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows, parts, pivots) of parts (rows, parts, width) to the pivots of their position."""
    return np.sqrt(((parts[:, :, None, :] - pivots[None]) ** 2).sum(axis=3).astype(np.float64))


def spread_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Per position, ``count`` (or as many as there are) of the first entries, each the one furthest from those before."""
    chosen = []
    for own in entries:
        picked = [0]
        gap = ((own - own[0]) ** 2).sum(axis=1)
        while len(picked) < min(count, len(own)):
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, ((own - own[picked[-1]]) ** 2).sum(axis=1))
        chosen.append(own[picked])
    return np.stack(chosen)


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ``BLOCK_ROWS`` rows with the integers of their last column but one or two, shaped (rows, parts, width)."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK_ROWS):
            block = batch.slice(low, BLOCK_ROWS)
            own = block.column(block.schema.get_field_index("ints")).flatten().to_numpy(zero_copy_only=False)
            yield block, own.reshape(block.num_rows, parts, -1)


def _measuring(pivots: np.ndarray):
    """Adds the distances to the pivots."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _blocks(batches, len(pivots)):
            found = pivot_distances(parts, pivots).reshape(-1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found), pivots.shape[0] * pivots.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*block.columns, lists], names=[*block.schema.names, "to_pivots"])

    return measured


def _distances(block: pa.RecordBatch, parts: int) -> np.ndarray:
    own = block.column(block.schema.get_field_index("to_pivots")).flatten().to_numpy(zero_copy_only=False)
    return own.reshape(block.num_rows, parts, -1)


def _summing(books: Codebooks):
    """One row per (part, entry) that a task assigned parts to: how many, and their sums."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, entries, width = books.entries.shape
        total, held = np.zeros((count * entries, width), np.int64), np.zeros(count * entries, np.int64)
        for block, parts in _blocks(batches, count):
            code, _, _ = books.nearest(parts, _distances(block, count))
            place = (code + np.arange(count) * entries).reshape(-1)
            np.add.at(total, place, parts.reshape(-1, width))
            held += np.bincount(place, minlength=count * entries)
        used = np.flatnonzero(held)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(total[used].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used]), sums], names=["place", "held", "sums"])

    return summed


def _coding(books: Codebooks):
    """(id, label, code, error) of every row."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(books.entries)
        digits = np.array([f"{i:02x}" for i in range(books.entries.shape[1])])
        for block, parts in _blocks(batches, count):
            code, error, _ = books.nearest(parts, _distances(block, count))
            told = ["".join(row) for row in digits[code]]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array(told, pa.string()), pa.array(error.sum(axis=1))],
                names=["id", "label", "code", "error"],
            )

    return coded


def _integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, ints) of the rows whose vector is neither null nor empty nor holds a null or non-finite component."""
    wide = F.col(vector_col).cast("array<double>")
    # NaN equals itself in Spark, so it is told by name; infinities lie outside the finite range.
    fit = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.exists(wide, lambda x: F.abs(F.floor(x * scale)) >= LARGEST)
    ints = F.when(large, F.raise_error(F.lit(f"an integer component reaches {LARGEST}")).cast("array<bigint>")).otherwise(
        F.transform(wide, lambda x: F.floor(x * scale).cast("bigint"))
    )
    return (
        vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("own"))
        .filter(F.col("own").isNotNull())
        .select("id", "label", F.col("own").alias(vector_col))
        .filter((F.size(vector_col) > 0) & fit)
        .select("id", "label", ints.alias("ints"))
    )


def fit_codebooks(ints: DataFrame, seeds: np.ndarray, pivots: np.ndarray, rounds: int) -> Codebooks:
    """Codebooks after ``rounds`` rounds over staged rows (ints, to_pivots); an entry no part chose stays as it is."""
    books = Codebooks(seeds, pivots)
    count, entries, width = seeds.shape
    for _ in range(rounds):
        sums = ints.select("ints", "to_pivots").mapInArrow(_summing(books), "place long, held long, sums array<long>")
        # At most parts x entries rows, whatever the size of the table.
        merged = sums.groupBy("place").agg(F.sum("held").alias("held"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
        moved = books.entries.reshape(-1, width).copy()
        for row in merged.collect():
            moved[row["place"]] = [row[f"s{i}"] // row["held"] for i in range(width)]
        books = Codebooks(moved.reshape(count, entries, width), pivots)
    return books


def encode_vectors(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, n_pivots: int = 4,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row with a usable vector.

    A component x becomes floor(scale * x). The codebook of a part position starts as that part of the ``entries`` rows with the
    smallest ids (a null id after all others, equal ids by vector; fewer rows: fewer entries). Each round assigns every part to
    the nearest entry by squared Euclidean distance, the lower index of equals, and moves an entry to the
    componentwise floor of its parts' mean. ``code`` holds the final indices, two hex digits a part, ``error``
    the final squared distances summed over the parts, ``label_error`` that sum over all rows with an equal label (null
    labels are equal), ``codebooks_sha256`` the digest of all entries, comma-joined by part, entry and place.

    Left out are rows whose vector is null, empty, holds a null or non-finite component, or differs in length from
    that of the first row by id. That length must be a multiple of ``parts``. Components of ``LARGEST`` or more after
    scaling raise, as their distances would not be exact. Repeated rows and null ids stay. Other columns are not read and may
    have any names. An empty table gives an empty one.
    """
    if not 1 <= entries <= 256 or parts < 1 or n_pivots < 1:
        raise ValueError("parts and n_pivots must be at least 1, entries from 1 to 256")
    scope = StagingScope(vectors.sparkSession, "codes")
    rows = _integers(vectors, scale, id_col, vector_col, label_col)
    order = [F.col("id").asc_nulls_last(), F.col("ints")]
    first = rows.orderBy(*order).limit(1).collect()
    size = len(first[0]["ints"]) if first else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    rows = rows.filter(F.size("ints") == size)
    # At most ``entries`` rows.
    start = rows.orderBy(*order).limit(entries).select("ints").collect()
    seeds = np.array([r["ints"] for r in start], dtype=np.int64).reshape(len(start), parts, size // parts).transpose(1, 0, 2)
    kind = rows.select("id", "label").schema
    told = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields)
    if not start:
        empty = f"`{id_col}` {kind[0].dataType.simpleString()}, code string, error bigint, label_error bigint, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    pivots = spread_pivots(seeds, n_pivots)
    measured = scope.stage(rows.mapInArrow(_measuring(pivots), f"{told}, ints array<bigint>, to_pivots array<double>"), "measured")
    books = fit_codebooks(measured, seeds, pivots, rounds)
    coded = scope.stage(measured.mapInArrow(_coding(books), f"{told}, code string, error bigint"), "coded")
    # Null labels are equal, so they get a key of their own that no text can have.
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    keyed = coded.withColumn("key", key)
    sums = scope.stage(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("held")), "sums")
    found = lookup_join(keyed, sums, "key", "inner", "held", F.xxhash64("id"))
    digest = hashlib.sha256(",".join(map(str, books.entries.reshape(-1).tolist())).encode()).hexdigest()
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
