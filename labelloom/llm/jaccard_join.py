"""N-gram Jaccard join by PartEnum signatures.

Sizes are cut into bands such that two sets with Jaccard >= t lie in the same or in neighbouring bands. A set
signs for its own band and for the next, so such a pair has a band in common, for which the largest possible
symmetric difference k is known. The shingle domain is hashed into groups of ``parts`` partitions each. Of g
groups at most k // (lost + 1) can hold more than ``lost`` differing shingles; in each other group some subset of
``parts - lost`` partitions holds none. A signature is the hash of a set restricted to such a subset, so with
more than k // (lost + 1) groups every sufficiently similar pair shares one.

Restrictions that are empty would be shared by unrelated sets. Some groups more than needed are made, and a set with no
more than that many groups that hold an empty restriction keeps its empty ones back: a pair still has a
group in common whose restriction is not empty. Sets with more of them sign for the empty ones as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.linking import SKETCH, similar_components
from labelloom.llm.rows import whole_row
from labelloom.llm.shingles import TextWords, mixed, parity_sketches, set_digests, some_texts
from labelloom.scale.joins import lookup_join
from labelloom.scale.staging import StagingScope

MAX_SEEN_SETS = 300_000


class PartEnum:
    """Signatures for Jaccard >= num / den."""

    def __init__(self, num: int, den: int, parts: int = 2, lost: int = 1) -> None:
        self.num, self.den, self.parts, self.lost = num, den, parts, lost
        self.subsets = list(combinations(range(parts), parts - lost))
        self.lows = [1]
        self._plans: dict[int, tuple[int, int, int]] = {}

    def top(self, band: int) -> int:
        """Largest size of a band."""
        return self.lows[band] * self.den // self.num

    def band(self, size: int) -> int:
        while self.top(len(self.lows) - 1) < size:
            self.lows.append(self.top(len(self.lows) - 1) + 1)
        if self.lows[-1] <= size:
            return len(self.lows) - 1
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def plan(self, band: int) -> tuple[int, int, int]:
        """For pairs in this band or in it and the one below: largest difference, groups, groups to spare."""
        if band not in self._plans:
            self.band(self.top(band) if band < len(self.lows) else self.lows[-1])
            while band >= len(self.lows):
                self.lows.append(self.top(len(self.lows) - 1) + 1)
            top = self.top(band)
            differing = 2 * top * (self.den - self.num) // (self.den + self.num)
            needed = differing // (self.lost + 1) + 1
            typical = math.sqrt(self.lows[max(band - 1, 0)] * top)
            void = min(1.0, len(self.subsets) * math.exp(-typical * (self.parts - self.lost) / (needed * self.parts)))
            spare = math.ceil(void * needed + 2 * math.sqrt(void * needed))
            self._plans[band] = (differing, needed + spare, spare)
        return self._plans[band]

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """Signatures of a non-empty set. Bands that allow no difference need none: equal sets are told by digest."""
        found = []
        own = self.band(len(shingles))
        for band in (own, own + 1):
            differing, groups, spare = self.plan(band)
            if differing == 0:
                continue
            cells = groups * self.parts
            cell = ((shingles >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
            cell = cell.astype(np.int64)
            sums = np.zeros(cells, dtype=np.uint64)
            np.add.at(sums, cell, mixed(shingles))
            sums, counts = sums.reshape(groups, self.parts), np.bincount(cell, minlength=cells).reshape(groups, self.parts)
            kept = [(sums[:, list(s)].sum(axis=1, dtype=np.uint64), counts[:, list(s)].sum(axis=1)) for s in self.subsets]
            void = np.zeros(groups, dtype=bool)
            for _, size in kept:
                void |= size == 0
            with_empty = int(void.sum()) > spare
            for i, (total, size) in enumerate(kept):
                place = np.arange(groups, dtype=np.uint64) * np.uint64(len(kept)) + np.uint64(i)
                sig = mixed(total + mixed(place + np.uint64((band + 1) << 40)))
                found.append(sig if with_empty else sig[size > 0])
        return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def _profiles(width: int, num: int, den: int):
    """From (node, text, further columns) to (node, n, digest, sketch, signatures, further columns)."""
    names = ["node", "n", "d0", "d1", *SKETCH, "sigs"]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enum, seen = PartEnum(num, den), set()
        for batch in batches:
            for part, texts in some_texts(batch, 1):
                shingles, sizes = TextWords(texts).shingle_sets(width)
                digests, ends = set_digests(shingles, sizes), np.cumsum(sizes)
                sigs, lengths = [], np.zeros(len(texts), dtype=np.int64)
                for i, digest in enumerate(map(tuple, digests.tolist())):
                    if sizes[i] and digest not in seen:
                        if len(seen) >= MAX_SEEN_SETS:
                            seen.clear()
                        seen.add(digest)
                        sigs.append(enum.signatures(shingles[ends[i] - sizes[i] : ends[i]]).view(np.int64))
                        lengths[i] = len(sigs[-1])
                flat = np.concatenate(sigs) if sigs else np.empty(0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat, pa.int64()))
                fixed = np.concatenate([sizes[:, None], digests, parity_sketches(shingles, sizes)], axis=1)
                columns = [part.column(0), *(pa.array(fixed[:, j]) for j in range(fixed.shape[1])), lists]
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], names=[*names, *part.schema.names[2:]])

    return profile


def _signed(
    texts: DataFrame, num: int, den: int, width: int, scope: StagingScope
) -> tuple[DataFrame, DataFrame]:
    """Staged profiles of (node, text, ...): the members (sig, node), and the rest of the profile."""
    numbers = ", ".join(f"{c} long" for c in ["node", "n", "d0", "d1", *SKETCH])
    more = "".join(f", `{c}` {kind}" for c, kind in texts.dtypes[2:])
    signed = scope.stage(
        texts.mapInArrow(_profiles(width, num, den), f"{numbers}, sigs array<long>{more}"), "signed"
    )
    members = signed.filter(F.col("node").isNotNull()).select(F.explode("sigs").alias("sig"), "node")
    return members, scope.stage(signed.drop("sigs"), "profiles")


def _components(
    members: DataFrame,
    profiles: DataFrame,
    texts_of: Callable[[DataFrame], DataFrame],
    width: int,
    num: int,
    den: int,
    scope: StagingScope,
) -> DataFrame:
    """(node, component) of every node with a non-empty set."""
    real = profiles.filter(F.col("node").isNotNull() & (F.col("n") > 0)).select("node", "n", "d0", "d1", *SKETCH)
    first = real.groupBy("d0", "d1").agg(F.min("node").alias("same_as"))
    same = real.select("node", "d0", "d1").join(first, ["d0", "d1"])
    nodes = scope.stage(same.select("node", "same_as", "d0", "d1").distinct(), "nodes")

    def sketches_of(ids: DataFrame) -> DataFrame:
        own = nodes.filter(F.col("node") == F.col("same_as")).select("node", "d0", "d1").join(ids, "node", "left_semi")
        return real.join(own, ["node", "d0", "d1"]).select("node", "n", *SKETCH).distinct()

    linked = similar_components(members, nodes, sketches_of, texts_of, width, num, den, scope, "docs", ("signed",)).withColumnRenamed("node", "same_as")
    alias = nodes.groupBy("node").agg(F.min("same_as").alias("same_as"))
    return alias.join(linked, "same_as", "left").select("node", F.coalesce("component", "same_as").alias("component"))


def jaccard_components(
    docs: DataFrame, num: int = 90, den: int = 100, width: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the similarity join as connected components.

    Two rows link when the Jaccard similarity of their sets of ``width``-word shingles is at least num / den;
    the component is the smallest id reachable by links. Null or wordless text has an empty set and links with
    nothing. Rows with a null id keep a null component. Rows that repeat an id stay, and share a component.
    Other columns are not read, so they may have any names. Copies are joined by a digest of their set, so
    their number never enters a signature group more than once per task.
    """
    scope = StagingScope(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    members, profiles = _signed(texts, num, den, width, scope)

    def texts_of(ids: DataFrame) -> DataFrame:
        return lookup_join(texts, ids, "node", "left_semi")

    found = _components(members, profiles, texts_of, width, num, den, scope)
    return profiles.select("node", "n").join(found, "node", "left").select(
        F.col("node").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")
    )


def first_of_groups(
    docs: DataFrame, num: int, den: int, width: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of every group of linked texts, with the columns of ``docs``: that with the smallest id (null first), then text digest.

    Rows are numbered once, when their profile is written, and found again by id and text digest, so null and repeated
    ids do no harm; of rows with equal id and text one stays. Texts without a word link with nothing. The wide
    rows are only joined with the keys of the rows that go.
    """
    scope = StagingScope(docs.sparkSession, "groups")
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), digest)
    texts = docs.select(
        F.monotonically_increasing_id().alias("node"), F.col(text_col).cast("string").alias("text"),
        F.col(id_col).alias("id"), digest.alias("digest"), key.alias("key"),
    )
    members, profiles = _signed(texts, num, den, width, scope)

    def texts_of(ids: DataFrame) -> DataFrame:
        asked = scope.stage(profiles.select("node", "key").join(ids, "node"), f"asked-{uuid4().hex}")
        found = lookup_join(docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text")), asked, "key")
        return found.select("node", "text")

    group = _components(members, profiles, texts_of, width, num, den, scope)
    rows = profiles.select("node", "id", "digest", "key").join(group, "node", "left")
    own = F.coalesce(F.col("component").cast("string"), F.col("key"))
    rows = scope.stage(rows.withColumn("group", own), "rows")
    chosen = rows.groupBy("group").agg(F.min(F.struct("id", "digest", "key")).alias("c")).select(F.col("c.key").alias("key"))
    marks = rows.groupBy("key").agg(F.count("*").alias("rows")).join(
        chosen.distinct().withColumn("stays", F.lit(True)), "key", "left"
    )
    marks = scope.stage(
        marks.filter(F.col("stays").isNull() | (F.col("rows") > 1)).select(
            F.col("key").alias("_key"), F.col("stays").isNull().alias("_gone"), F.col("rows").alias("_rows")
        ),
        "marks",
    )
    marked = lookup_join(docs.select(whole_row(docs), key.alias("_key")), marks, "_key", "left", "_rows", F.rand(7))
    kept = marked.filter(F.col("_gone").isNull()).select("row.*")
    if marks.filter(~F.col("_gone")).isEmpty():
        return kept
    repeated = marked.filter(~F.col("_gone")).dropDuplicates(["_key"]).select("row.*")
    return kept.unionByName(repeated)
