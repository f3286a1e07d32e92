"""From shared signatures to connected components of similar sets, without listing the pairs of a group.

``members`` (sig, node) holds a row for every signature of every node; nodes that share one are candidates.
Links are looked for in two rounds:

1. One member of each signature is its hub. Every node is tried against one hub, that with which it shares most
   signatures, so a group of m near copies costs m tries. Verified links are merged into components. This is repeated with other hubs
   for the signatures that still hold several components, in later turns with several hubs each, as long as
   that finds links and the pairs left are many more than the members.
2. Members of one signature that are still in different components are compared inside the join itself:
   its condition holds the size rule and the parity-sketch bound, and lets through only pairs which may be
   links. Those are verified exactly.

After round 2 no unverified candidate pair joins two components, so the components are those of all links
between nodes that share a signature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.shingles import SKETCH_WORDS, TextWords, parity_sketch, some_texts
from labelloom.llm.components import connected_components
from labelloom.scale.staging import StagingScope

MAX_KEPT_SETS = 200
HUBS = (1, 8, 8, 8, 8, 8)  # hubs of a signature in each further turn
CROWDED, FEW = 16, 1_000  # pairs a member beyond which the last join waits for another turn, and members a link below which it does not
SLICES = 4  # parts of the signature space that are shuffled one after another
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def may_link(a: str, b: str, num: int, den: int, sketch: list[str]) -> Column:
    """Necessary condition for Jaccard >= num / den of two sets, from their sizes and sketches."""
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in sketch), F.lit(0))
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (apart * (den + num) <= (n_a + n_b) * (den - num)) & (n_a * den >= n_b * num) & (n_b * den >= n_a * num)


def similar_components(
    members: DataFrame,
    nodes: DataFrame,
    sketches_of: Callable[[DataFrame], DataFrame],
    texts_of: Callable[[DataFrame], DataFrame],
    width: int,
    num: int,
    den: int,
    scope: StagingScope,
    label: str,
    spent: tuple[str, ...] = (),
) -> DataFrame:
    """(node, component): components of the nodes linked by Jaccard >= num / den; nodes without a link are left out.

    ``nodes``: (node, same_as) with the node that stands for all equal sets in ``same_as``;
    ``sketches_of(ids)`` gives (node, n, s0..), sizes and sketches, and ``texts_of(ids)`` (node, text) of the asked
    nodes; a set holds the ``width``-word shingles of its text. Only nodes of candidate pairs are asked for.
    ``spent`` names tables of the scope that are dropped once the members were read.
    """
    by_sig = Window.partitionBy("sig")
    slices = [f"{label}-shared-{i}" for i in range(SLICES)]
    shared = _shared(members, scope, slices)
    scope.release(*spent)
    alias = nodes.select("node", "same_as")
    pairs = shared.filter(F.col("node") != F.col("hub")).groupBy("hub", "node").agg(F.count("*").alias("shared"))
    pairs = (
        pairs.join(alias, "node")
        .select("hub", F.col("same_as").alias("x"), "shared")
        .join(alias.withColumnRenamed("node", "hub"), "hub")
        .select(F.col("same_as").alias("a"), F.col("x").alias("b"), "shared")
        .filter(F.col("a") != F.col("b"))
    )
    links = _from_hubs(pairs, sketches_of, texts_of, width, num, den, scope, f"{label}-hub")
    # A node with several sets (a repeated id) ties their components together.
    tied = alias.join(alias.groupBy("node").agg(F.min("same_as").alias("a")), "node").select(
        "a", F.col("same_as").alias("b")
    )
    links = links.unionByName(tied.filter(F.col("a") != F.col("b")).distinct())
    labels = connected_components(links, scope, f"{label}-first")
    mixed = _mixed(shared.join(alias, "node").select("sig", F.col("same_as").alias("node")), labels, scope, f"{label}-mixed-0")
    scope.release(*slices)
    for turn, hubs in enumerate(HUBS, 1):
        if mixed.isEmpty():
            return labels
        if turn > 1:
            rows, apart = _crowd(mixed)
            if apart <= CROWDED * rows or found * FEW < rows:
                break  # the last join is small, or other hubs would hardly find more
        chosen = [
            F.min(F.struct(F.xxhash64("node", F.lit(turn), F.lit(i)).alias("h"), F.col("node").alias("a"), F.col("component").alias("c"))).over(by_sig)
            for i in range(hubs)
        ]
        tries = mixed.select("node", "component", F.array(*chosen).alias("hubs")).select("node", "component", F.inline("hubs"))
        pairs = tries.filter(F.col("component") != F.col("c")).select("a", F.col("node").alias("b"), F.lit(1).alias("shared"))
        more = _from_hubs(pairs, sketches_of, texts_of, width, num, den, scope, f"{label}-hub-{turn}", hubs > 1)
        if not (found := more.count()):
            break  # the last join looks at all that is left
        links = links.unionByName(more)
        labels = connected_components(links, scope, f"{label}-turn-{turn}")
        mixed = _mixed(mixed.select("sig", "node"), labels, scope, f"{label}-mixed-{turn}")
    if mixed.isEmpty():
        return labels
    mixed = mixed.join(scope.stage(sketches_of(mixed.select("node").distinct()), f"{label}-mixed-sketches"), "node")
    p, q = mixed.alias("p"), mixed.alias("q")
    apart = (
        (F.col("p.sig") == F.col("q.sig"))
        & (F.col("p.node") < F.col("q.node"))
        & (F.col("p.component") != F.col("q.component"))
        & may_link("p", "q", num, den, SKETCH)
    )
    tried = p.join(q, apart).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
    more = _verified(tried, texts_of, width, num, den, scope, f"{label}-rest", sketched=True)
    return connected_components(links.unionByName(more), scope, f"{label}-last")


def _shared(members: DataFrame, scope: StagingScope, labels: list[str]) -> DataFrame:
    """(sig, node, hub) of the signatures of more than one node, the signature space cut into a slice per label.

    Signatures are many more than those shared, so no more than a slice of them lies in shuffle files at a time.
    """
    by_sig = Window.partitionBy("sig")
    found = []
    for i, label in enumerate(labels):
        part = members.filter(F.pmod("sig", F.lit(len(labels))) == i)
        ends = part.select("sig", "node", F.min("node").over(by_sig).alias("hub"), F.max("node").over(by_sig).alias("top"))
        found.append(scope.stage(ends.filter(F.col("hub") != F.col("top")).select("sig", "node", "hub"), label))
        scope.release()
    return reduce(DataFrame.unionByName, found)


def _mixed(members: DataFrame, labels: DataFrame, scope: StagingScope, label: str) -> DataFrame:
    """(sig, node, component) of the signatures whose members are in several components. Rows are narrow."""
    by_sig = Window.partitionBy("sig")
    return scope.stage(
        members.join(labels, "node", "left")
        .select("sig", "node", F.coalesce("component", "node").alias("component"))
        .withColumn("low", F.min("component").over(by_sig))
        .withColumn("high", F.max("component").over(by_sig))
        .filter(F.col("low") != F.col("high"))
        .dropDuplicates(["sig", "node"])
        .select("sig", "node", "component"),
        label,
    )


def _crowd(mixed: DataFrame) -> tuple[float, float]:
    """Members of the signatures, and pairs of members of one signature in different components."""
    sizes = mixed.groupBy("sig", "component").agg(F.count("*").cast("double").alias("m"))
    told = sizes.groupBy("sig").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
    return told.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("own")) / 2)).first()


def _from_hubs(
    pairs: DataFrame,
    sketches_of: Callable[[DataFrame], DataFrame],
    texts_of: Callable[[DataFrame], DataFrame],
    width: int,
    num: int,
    den: int,
    scope: StagingScope,
    label: str,
    every: bool = False,
) -> DataFrame:
    """Links among pairs (a hub, b node, signatures shared); each node is tried against the hub it shares most with, or ``every`` one.

    That is chosen before sketches are joined, so these move once a node of a pair, and not at all for the others.
    """
    if every:
        best = pairs.select("a", "b").distinct()
    else:
        votes = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        best = votes.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    best = scope.stage(best, f"{label}-best")
    asked = best.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sketches = scope.stage(sketches_of(asked), f"{label}-asked-sketches")
    scope.release()
    links = _verified(_sketched(best, sketches, num, den), texts_of, width, num, den, scope, label)
    scope.release(f"{label}-best", f"{label}-asked-sketches")
    return links


def _sketched(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the full sketches let through."""
    return (
        pairs.join(sketches.alias("p"), F.col("a") == F.col("p.node"))
        .join(sketches.alias("q"), F.col("b") == F.col("q.node"))
        .filter(may_link("p", "q", num, den, SKETCH))
        .select("a", "b")
    )


def _verified(
    pairs: DataFrame,
    texts_of: Callable[[DataFrame], DataFrame],
    width: int,
    num: int,
    den: int,
    scope: StagingScope,
    label: str,
    sketched: bool = False,
) -> DataFrame:
    """The pairs (a, b) whose sets have exact Jaccard >= num / den. Texts travel rather than sets: they compress.

    A sketch of fixed length tells nothing about sets much larger than it. With ``sketched``, pairs are first tried by
    sketches as long as their sets need, so that texts travel for few pairs only.
    """
    pairs = scope.stage(pairs, f"{label}-tried")
    ids = scope.stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{label}-ids")
    texts = scope.stage(texts_of(ids), f"{label}-texts")
    kinds = texts.select("node", F.xxhash64("text").alias("kind"))
    if kinds.count() > kinds.distinct().count():  # repeated rows of the input
        texts = scope.stage(texts.dropDuplicates(["node", "text"]), f"{label}-single-texts")
        scope.drop(f"{label}-texts")
    if sketched:
        long = scope.stage(texts.mapInArrow(_sketching(width), "node long, n long, sketch binary"), f"{label}-sketches")
        near = pairs.join(long.toDF("a", "n_a", "sketch_a"), "a").join(long.toDF("b", "n_b", "sketch_b"), "b")
        near = near.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
        pairs = scope.stage(near.mapInArrow(_near(num, den), "a long, b long").distinct(), f"{label}-near")
    compared = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    links = scope.stage(compared.mapInArrow(_linking(width, num, den), "a long, b long"), f"{label}-links")
    scope.release(*(f"{label}-{part}" for part in ("tried", "ids", "texts", "single-texts", "sketches", "near")))
    return links


def _sketching(width: int):
    """From (node, text) to (node, size of its set, parity sketch of at least as many bits)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in some_texts(batch, 1):
                shingles, sizes = TextWords(texts).shingle_sets(width)
                sets = np.split(shingles, np.cumsum(sizes)[:-1])
                sketches = [parity_sketch(s, max(SKETCH_WORDS, 1 << max(len(s) - 1, 0).bit_length() >> 6)).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
                    names=["node", "n", "sketch"],
                )

    return made


def _near(num: int, den: int):
    """Keeps the pairs that sizes and sketches let through; the longer sketch is folded to the length of the other."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, dtype=bool)
            n_a, n_b, left, right = (batch.column(i).to_pylist() for i in range(2, 6))
            for i in range(batch.num_rows):
                bits = min(len(left[i]), len(right[i]))
                one, other = (np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, bits)) for x in (left[i], right[i]))
                apart = int(np.bitwise_count(one ^ other).sum())
                fair = n_a[i] * den >= n_b[i] * num and n_b[i] * den >= n_a[i] * num
                kept[i] = fair and apart * (den + num) <= (n_a[i] + n_b[i]) * (den - num)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    return near


def _linking(width: int, num: int, den: int):
    """Keeps the rows whose two texts link. Rows come in runs of one text, whose set is made once."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in some_texts(batch, 2):
                if len(sets) >= MAX_KEPT_SETS:
                    sets.clear()
                others = part.column(3).to_pylist()
                new = [t for t in dict.fromkeys([*texts, *others]) if t not in sets]
                shingles, sizes = TextWords(new).shingle_sets(width)
                sets.update(zip(new, np.split(shingles, np.cumsum(sizes)[:-1])))
                links = np.zeros(len(texts), dtype=bool)
                for i, (left, right) in enumerate(zip(map(sets.__getitem__, texts), map(sets.__getitem__, others))):
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    links[i] = both * den >= (len(left) + len(right) - both) * num
                yield part.select(["a", "b"]).filter(pa.array(links))

    return kept
