"""Near-duplicates by SimHash: fingerprints, and a self-join of their binary trie within a Hamming budget.

Fingerprints are bits read from the highest down; a trie node is a common prefix. The join walks pairs of nodes
of equal depth together, adds up the bits in which their prefixes differ, and leaves a pair as soon as that
exceeds the budget. Two tries share the work: fingerprints with at most m differing bits have at most m // 2 of
them in the first 32, or at most m - m // 2 - 1 in the last 32. So one trie is walked as it is and one over
fingerprints turned by 32 bits, each with the smaller budget for its first half and m for the whole.

The top of the trie is walked as DataFrames: nodes are counted prefixes, and a pair whose nodes hold more than
``NODE_ROWS`` fingerprints is replaced by the pairs of their children, ``STEP`` bits deeper. Below, a task takes one
pair of nodes with all their fingerprints (a bounded number) and walks on in NumPy, many pairs at once. A task reports a
forest over the fingerprints it linked, not the pairs: as many edges at most as it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.components import connected_components
from labelloom.scale.joins import lookup_join
from labelloom.scale.staging import StagingScope

NODE_ROWS = 16_384  # fingerprints of a node that one task takes whole
STEP = 4  # bits by which the distributed part goes down at a time
LEAF_PAIRS = 32  # node pairs with so few pairs of fingerprints are compared at once
FRONTIER = 100_000  # node pairs walked together
BITS = 64


# --- fingerprints ---------------------------------------------------------------


def fingerprint_of(words: list[bytes], width: int, seed: int) -> int:
    """Majority of the bits of the XXH64 values of all runs of ``width`` words, repeats included; 0 without words."""
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    lows = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    shingles = map(line.__getitem__, map(slice, lows, ends[width - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(lows))
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(lows), bitorder="little").view(np.uint64)[0])


def _hashing(width: int, seed: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((t or "").encode("utf-8", "replace").lower().split() for t in batch.column(1).to_pylist())
            bits = np.fromiter((fingerprint_of(t, width, seed) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["id", "bits"])

    return hashed


def simhash_fingerprints(
    docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, bits) of every row: the 64-bit SimHash of its whole text as a long.

    A-Z become a-z; words are the maximal stretches without space or 0x09-0x0D. A bit is 1 if it is set in over half of the
    XXH64 values of the runs of ``width`` words, repeats counted; a shorter text is one run, and a null,
    empty or wordless one has the fingerprint 0.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_hashing(width, seed), f"id {rows.schema[0].dataType.simpleString()}, bits long")


# --- the trie inside a task ---------------------------------------------------------


class Trie:
    """Nodes of the binary trie over ascending fingerprints, one level at a time and each level once.

    A node is a range [low, high) of the fingerprints; ``child(side)`` gives the number of its child in the next level or -1.
    """

    def __init__(self, prints: np.ndarray, depth: int) -> None:
        self.prints, self.depth = prints, depth
        self.low, self.high = [np.array([0])], [np.array([len(prints)])]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []

    def split(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level == len(self.children):
            low, high = self.low[level], self.high[level]
            shift = np.uint64(BITS - 1 - self.depth - level)
            first_set = (self.prints[low] >> shift | np.uint64(1)) << shift
            middle = np.clip(np.searchsorted(self.prints, first_set), low, high)
            has = np.stack([middle > low, high > middle], axis=1)
            number = np.where(has, np.cumsum(has).reshape(has.shape) - 1, -1)
            self.children.append((number[:, 0], number[:, 1]))
            self.low.append(np.stack([low, middle], axis=1)[has])
            self.high.append(np.stack([middle, high], axis=1)[has])
        return self.children[level]


class Forest:
    """Components of numbered items, merged by arrays of links."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                onward = self.root[self.root]
                if (onward == self.root).all():
                    break
                self.root = onward


def joined(left: np.ndarray, right: np.ndarray | None, depth: int, half: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (x, y) of the fingerprints linked across two nodes of ``depth``, or inside one (``right`` None).

    ``half`` is the budget of the first 32 bits, ``most`` that of all. Fingerprints are ascending and distinct.
    """
    same = right is None
    a_trie = Trie(left, depth)
    b_trie = a_trie if same else Trie(right, depth)
    prints = left if same else np.concatenate((left, right))
    offset = 0 if same else len(left)
    differing = 0 if same else int(np.bitwise_count((left[0] ^ right[0]) >> np.uint64(BITS - depth))) if depth else 0
    forest = Forest(len(prints))
    zero = np.zeros(1, dtype=np.int64)
    open_pairs = [(0, zero, zero, np.array([differing]))]
    while open_pairs:
        level, a, b, error = open_pairs.pop()
        if len(a) > FRONTIER:
            middle = len(a) // 2
            open_pairs += [(level, a[:middle], b[:middle], error[:middle]), (level, a[middle:], b[middle:], error[middle:])]
            continue
        rows_a = a_trie.high[level][a] - a_trie.low[level][a]
        rows_b = b_trie.high[level][b] - b_trie.low[level][b]
        few = (rows_a * rows_b <= LEAF_PAIRS) | (depth + level == BITS)
        if few.any():
            _compare(a_trie, b_trie, level, a[few], b[few], prints, offset, most, forest)
            a, b, error = a[~few], b[~few], error[~few]
        if not len(a):
            continue
        budget = half if depth + level < BITS // 2 else most
        (a0, a1), (b0, b1) = a_trie.split(level), b_trie.split(level)
        crossed = error < budget
        back = crossed if not same else crossed & (a != b)  # inside one node, (1, 0) is (0, 1) again
        a_next = np.concatenate((a0[a], a1[a], a0[a[crossed]], a1[a[back]]))
        b_next = np.concatenate((b0[b], b1[b], b1[b[crossed]], b0[b[back]]))
        e_next = np.concatenate((error, error, error[crossed] + 1, error[back] + 1))
        real = (a_next >= 0) & (b_next >= 0)
        if real.any():
            open_pairs.append((level + 1, a_next[real], b_next[real], e_next[real]))
    moved = np.flatnonzero(forest.root != np.arange(len(prints)))
    return prints[moved], prints[forest.root[moved]]


def _compare(a_trie, b_trie, level, a, b, prints, offset, most, forest) -> None:
    """Link the fingerprints of the given node pairs that differ in at most ``most`` bits."""
    low_a, low_b = a_trie.low[level][a], b_trie.low[level][b]
    rows_b = b_trie.high[level][b] - low_b
    sizes = (a_trie.high[level][a] - low_a) * rows_b
    pair = np.repeat(np.arange(len(a)), sizes)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = low_a[pair] + place // rows_b[pair]
    y = low_b[pair] + place % rows_b[pair] + offset
    close = np.bitwise_count(prints[x] ^ prints[y]) <= most
    forest.link(x[close], y[close])


def _joining(half: int, most: int, turned: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left = batch.column(0)[i].values.to_numpy().view(np.uint64)
                right = batch.column(1)[i].values
                left = np.sort(left)
                right = None if right is None else np.sort(right.to_numpy().view(np.uint64))
                ends = joined(left, right, batch.column(2)[i].as_py(), half, most)
                back = [(e >> np.uint64(turned) | e << np.uint64((BITS - turned) % BITS)).view(np.int64) for e in ends]
                yield pa.RecordBatch.from_arrays([pa.array(e) for e in back], schema=schema)

    return edges


# --- the trie across tasks ------------------------------------------------------------


def _prefix(bits: Column, depth: int) -> Column:
    return F.shiftrightunsigned(bits, BITS - depth) if depth else F.lit(0).cast("long")


def _turned_edges(prints: DataFrame, half: int, most: int, turned: int, scope: StagingScope, node_rows: int) -> DataFrame:
    """Edges (a, b) among the distinct fingerprints ``bits``, walked in a trie whose first bit is bit ``turned``."""
    own = F.col("bits")
    if turned:
        own = F.shiftleft(own, turned).bitwiseOR(F.shiftrightunsigned(own, BITS - turned))
    prints = prints.select(own.alias("bits"))
    label = f"turn-{turned}"

    def nodes_at(depth: int) -> DataFrame:
        return prints.groupBy(_prefix(F.col("bits"), depth).alias("node")).agg(F.count("*").alias("rows"))

    spark = prints.sparkSession
    open_pairs = nodes_at(0).select(F.col("node").alias("u"), F.col("node").alias("v"), F.col("rows").alias("most_rows"))
    open_pairs = scope.stage(open_pairs, f"{label}-pairs-0")
    depth, edges = 0, None
    while True:
        small = (F.col("most_rows") <= node_rows) if depth < BITS else F.lit(True)
        ready = open_pairs.filter(small).select("u", "v")
        count = ready.count()
        if count:
            used = ready.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            here = prints.select(_prefix(F.col("bits"), depth).alias("node"), "bits")
            lists = lookup_join(here, scope.stage(used, f"{label}-used-{depth}"), "node", "left_semi")
            lists = scope.stage(lists.groupBy("node").agg(F.collect_list("bits").alias("own")), f"{label}-lists-{depth}")
            tasks = max(spark.sparkContext.defaultParallelism, count // 8)
            work = (
                ready.join(lists.select(F.col("node").alias("u"), F.col("own").alias("left")), "u")
                .join(lists.select(F.col("node").alias("v"), F.col("own").alias("right")), "v")
                .select("left", F.when(F.col("u") != F.col("v"), F.col("right")).alias("right"), F.lit(depth).alias("depth"), "u", "v")
                .repartition(tasks, F.xxhash64("u", "v"))
                .select("left", "right", "depth")
            )
            found = scope.stage(work.mapInArrow(_joining(half, most, turned), "a long, b long"), f"{label}-edges-{depth}")
            edges = found if edges is None else edges.unionByName(found)
        if count == open_pairs.count():
            return edges
        depth += STEP
        nodes = scope.stage(nodes_at(depth), f"{label}-nodes-{depth}")
        over = F.shiftrightunsigned("node", STEP)
        left = nodes.select(over.alias("u"), F.col("node").alias("x"), F.col("rows").alias("x_rows"))
        right = nodes.select(over.alias("v"), F.col("node").alias("y"), F.col("rows").alias("y_rows"))
        budget = half if depth <= BITS // 2 else most
        close = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= budget
        deeper = open_pairs.filter(~small).join(left, "u").join(right, "v").filter(close & ((F.col("u") != F.col("v")) | (F.col("x") <= F.col("y"))))
        deeper = deeper.select(F.col("x").alias("u"), F.col("y").alias("v"), F.greatest("x_rows", "y_rows").alias("most_rows"))
        open_pairs = scope.stage(deeper, f"{label}-pairs-{depth}")


def hamming_components(prints: DataFrame, most: int, scope: StagingScope, node_rows: int = NODE_ROWS) -> DataFrame:
    """(node, component) of the distinct fingerprints ``bits`` that link with another one at ``most`` or fewer differing bits."""
    if not 0 <= most < BITS // 2:
        raise ValueError(f"most must be from 0 to {BITS // 2 - 1}")
    half = most // 2
    edges = _turned_edges(prints, half, most, 0, scope, node_rows)
    if most - half - 1 >= 0 and edges is not None:
        edges = edges.unionByName(_turned_edges(prints, most - half - 1, most, BITS // 2, scope, node_rows))
    if edges is None:
        edges = prints.sparkSession.createDataFrame([], "a long, b long")
    return connected_components(edges, scope, "prints")


def simhash_components(
    docs: DataFrame, most: int = 4, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """(id, fingerprint, component_id) of every row: SimHash near-duplicates as connected components.

    Two rows link when their fingerprints (:func:`simhash_fingerprints`) differ in at most ``most`` bits; the component is the
    smallest id reachable by links. ``fingerprint`` has 16 lower-case hex digits. Rows without a word have fingerprint 0
    and link like any other. Rows with equal fingerprints are one item of the join, so the number of copies never enters it. A
    row with a null id links, but names no component: its component is null if it reaches no id. Rows that
    repeat an id stay, each with the component of its own text. Other columns are not read and may have any names.
    """
    scope = StagingScope(docs.sparkSession, "simhash")
    rows = scope.stage(simhash_fingerprints(docs, width, seed, id_col, text_col), "rows")
    groups = scope.stage(
        rows.groupBy("bits").agg(F.min("id").alias("first"), F.count("*").alias("held")), "groups"
    )
    linked = hamming_components(groups.select("bits"), most, scope, node_rows)
    linked = scope.stage(groups.join(linked.withColumnRenamed("node", "bits"), "bits", "left"), "linked")
    firsts = linked.filter(F.col("component").isNotNull()).groupBy("component").agg(
        F.min("first").alias("least"), F.count("*").alias("members")
    )
    firsts = scope.stage(firsts, "firsts")
    named = lookup_join(linked, firsts, "component", "left", "members", F.col("bits"))
    own = F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least"))
    # A row whose fingerprint is its own alone and links with none needs no look-up.
    named = scope.stage(
        named.filter((F.col("held") > 1) | F.col("component").isNotNull()).select("bits", own.alias("reached"), "held"), "named"
    )
    found = lookup_join(rows, named, "bits", "left", "held", F.xxhash64("id"))
    reached = F.when(F.col("held").isNull(), F.col("id")).otherwise(F.col("reached"))
    return found.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), reached.alias("component_id")
    )
