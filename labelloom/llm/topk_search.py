"""Exact top-k inner-product search with a ball tree per shard.

Vectors are dealt to shards by a hash of their id, so copies and clusters spread evenly. A task builds the ball
tree of its shard (halving the points at the median of the widest axis, so that equal points end too) and
streams queries through it. A node's points lie within ``radius`` of its centre, so no inner product in it
exceeds q.centre + |q| * radius. Nodes are entered in falling order of that bound and skipped when it
is below the query's k-th best score so far.

That score is shared between shards in two passes: each query first searches one shard, and takes the k-th
score found there to all the others as its floor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.scale.staging import StagingScope

SHARD_ROWS = 4_096
LEAF_ROWS = 128
_EXACT = float(1 << 53)
_NONE = np.iinfo(np.int64).min


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    low: int
    high: int
    left: "Node | None" = None
    right: "Node | None" = None


class BallTree:
    """Points with ids; ``exact`` says that all inner products fit a double without rounding."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        self.order = np.arange(len(ids))
        self.float_points = points.astype(np.float64)
        self.root = self._build(0, len(ids))
        self.ids, self.points = ids[self.order], points[self.order]
        self.float_points = self.float_points[self.order]
        self.longest = float(np.sqrt((self.float_points**2).sum(axis=1)).max())

    def _build(self, low: int, high: int) -> Node:
        own = self.float_points[self.order[low:high]]
        centre = own.mean(axis=0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-9)
        node = Node(centre, radius, low, high)
        if high - low > LEAF_ROWS:
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            middle = (high - low) // 2
            split = np.argpartition(own[:, axis], middle)
            self.order[low:high] = self.order[low:high][split]
            node.left, node.right = self._build(low, low + middle), self._build(low + middle, high)
        return node


class Search:
    """Best k of a tree for a block of queries; ``floor`` holds a score that k others are known to reach."""

    def __init__(self, tree: BallTree, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.tree, self.ids, self.queries, self.k = tree, ids, queries, k
        self.floats = queries.astype(np.float64)
        self.norms = np.sqrt((self.floats**2).sum(axis=1))
        self.exact = tree.longest * float(self.norms.max(initial=0.0)) < _EXACT / 2
        self.floor = floor.copy()
        self.scores = np.full((len(ids), k), _NONE, dtype=np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, dtype=np.int64)
        self._visit(tree.root, np.arange(len(ids)), self._bound(tree.root, np.arange(len(ids))))

    def _bound(self, node: Node, who: np.ndarray) -> np.ndarray:
        reach = self.floats[who] @ node.centre + self.norms[who] * node.radius
        return reach + 1e-6 + 1e-9 * np.abs(reach) + 1e-9 * self.norms[who] * self.tree.longest

    def _visit(self, node: Node, who: np.ndarray, bound: np.ndarray) -> None:
        alive = bound >= self.floor[who]
        who = who[alive]
        if not len(who):
            return
        if node.left is None:
            self._scan(node, who)
            return
        left, right = self._bound(node.left, who), self._bound(node.right, who)
        first = left >= right
        for a, b, a_bound, b_bound, mask in (
            (node.left, node.right, left, right, first),
            (node.right, node.left, right, left, ~first),
        ):
            if mask.any():
                self._visit(a, who[mask], a_bound[mask])
                self._visit(b, who[mask], b_bound[mask])

    def _scan(self, node: Node, who: np.ndarray) -> None:
        tree, rows = self.tree, slice(node.low, node.high)
        if self.exact:
            scores = np.rint(self.floats[who] @ tree.float_points[rows].T).astype(np.int64)
        else:
            scores = self.queries[who] @ tree.points[rows].T
        ids = tree.ids[rows]
        allowed = (scores >= self.floor[who][:, None]) & (ids[None, :] != self.ids[who][:, None])
        some = allowed.any(axis=1)
        if not some.any():
            return
        who, scores, allowed = who[some], scores[some], allowed[some]
        all_scores = np.concatenate([self.scores[who], np.where(allowed, scores, _NONE)], axis=1)
        own = np.where(allowed, np.broadcast_to(ids, scores.shape), np.iinfo(np.int64).max)
        all_ids = np.concatenate([self.found[who], own], axis=1)
        best = np.lexsort((all_ids, -all_scores.astype(np.float64) if self.exact else ~all_scores), axis=1)[:, : self.k]
        self.scores[who] = np.take_along_axis(all_scores, best, axis=1)
        self.found[who] = np.take_along_axis(all_ids, best, axis=1)
        self.floor[who] = np.maximum(self.floor[who], self.scores[who][:, -1])


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return np.asarray(column.flatten()).reshape(rows, -1) if rows else np.empty((0, 0), dtype=np.int64)


def _searched(k: int):
    """Streams rows sorted by (dim, shard, kind): the points (kind 0) of a shard, then its queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, points, tree = None, [], [], None
        for batch in batches:
            dims, shards, kinds = (np.asarray(batch.column(i)) for i in range(3))
            edges = np.flatnonzero(
                (np.diff(dims) != 0) | (np.diff(shards) != 0) | (np.diff(kinds) != 0)
            ) + 1
            for low, high in zip([0, *edges], [*edges, batch.num_rows]):
                if low == high:
                    continue
                if (dims[low], shards[low]) != shard:
                    shard, ids, points, tree = (dims[low], shards[low]), [], [], None
                part = batch.slice(low, high - low)
                own_ids, vectors = np.asarray(part.column(3)), _matrix(part.column(4))
                if kinds[low] == 0:
                    ids.append(own_ids)
                    points.append(vectors)
                    continue
                if tree is None and ids:
                    tree = BallTree(np.concatenate(ids), np.concatenate(points))
                if tree is None:
                    continue
                done = Search(tree, own_ids, vectors, np.asarray(part.column(5)), k)
                row, place = np.nonzero(done.scores > _NONE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own_ids[row]), pa.array(done.found[row, place]), pa.array(done.scores[row, place])],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long; null if the vector is null, empty or holds null, NaN or an infinity."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query row, ties to the smaller id.

    Vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take no part. Vectors are compared
    with those of equal length. A row is never a result of its own id. A repeated (id, vector) is searched
    once as a query; as a candidate each id counts once per distinct vector. Inner products must fit a long.

    Memory of a task: one shard (``shard_rows`` vectors) and one batch of queries. The query set goes to every shard, narrow and once
    per pass, so the work is |queries| x |vectors| less what the bounds save, with no row collected.
    """
    scope = StagingScope(vectors.sparkSession, "topk")
    coded = scope.stage(
        vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        .dropDuplicates(["id", "v"]),
        "coded",
    ).withColumn("dim", F.size("v"))
    shards = scope.stage(
        coded.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "shards"
    )
    # One row per vector length; lengths are few by nature and the table is counted before it is sent out.
    sized = F.broadcast(shards) if shards.limit(10_001).count() <= 10_000 else shards
    home = F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")
    rows = coded.join(sized, "dim")
    columns = ["dim", "shard", "kind", "id", "v", "floor"]
    no_floor = F.lit(_NONE + 1)
    points = rows.withColumns({"shard": home, "kind": F.lit(0), "floor": no_floor})
    asked = rows.filter("q")
    at_home = asked.withColumns({"shard": home, "kind": F.lit(1), "floor": no_floor})
    seed = scope.stage(_search_pass(points.select(columns), at_home.select(columns), k), "seed")
    floors = seed.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("f"))
    away = (
        asked.join(floors, asked["id"] == floors["query_id"], "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .filter(F.col("shard") != home)
        .withColumns({"kind": F.lit(1), "floor": F.coalesce("f", no_floor)})
    )
    rest = _search_pass(points.select(columns), away.select(columns), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        seed.unionByName(rest)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _search_pass(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    dealt = points.unionByName(queries).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    return dealt.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
