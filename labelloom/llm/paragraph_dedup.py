"""Substring deduplication by paragraph MinHash banding, and of passages wherever they stand.

A paragraph is a line of a text with at least ``least_words`` words, or a run of shorter lines between longer or blank
ones that has as many (hard-wrapped prose, lists, verse); its set holds the 5-word shingles. MinHash
values are cut into bands, as many and as long as give the asked recall at the threshold; paragraphs that
agree in a band are candidates. Candidates are verified by exact Jaccard and merged into components
(``linking``), and of every component all paragraphs but the first, by document and place, are removals.

What stays is searched for passages of at least ``run`` words that stand in it more than once, whatever the line ends and
the text around them (``repeated_passages``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.linking import SKETCH, similar_components
from labelloom.llm.rows import whole_row
from labelloom.llm.shingles import SKETCH_WORDS, TOGETHER, TextWords, hashes_of, mixed, parity_sketches, set_digests, shingle_sets, some_texts
from labelloom.scale.joins import lookup_join
from labelloom.scale.staging import StagingScope

WIDTH, LEAST_WORDS, MOST_HASHES = 5, 25, 128
RECALL = 0.9999
MAX_SEEN = 300_000
RUN, GRAM = 50, 25
# Odd factors of the two hashes of a run of words.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def bands_for(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands with which a pair at the threshold collides with probability ``recall``."""
    best = (most, 1)
    for rows in range(1, most + 1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
        else:
            break
    return best


class MinHash:
    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(20240607)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(1, 1 << 62, size=(bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = rng.integers(0, 1 << 63, size=(bands * rows, 1), dtype=np.uint64)
        self.places = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        self.salt = mixed(np.arange(bands, dtype=np.uint64))

    def signatures(self, shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One hash per band, a row for each of the non-empty sets that stand one after another."""
        starts = np.cumsum(sizes) - sizes
        lowest = np.empty((len(sizes), len(self.factors)), dtype=np.uint64)
        for j, (factor, shift) in enumerate(zip(self.factors[:, 0], self.shifts[:, 0])):
            lowest[:, j] = np.minimum.reduceat(shingles * factor + shift, starts)
        grouped = mixed(lowest.reshape(-1, self.bands, self.rows)) * self.places
        return mixed(grouped.sum(axis=2, dtype=np.uint64) + self.salt)


def paragraphs(text: str | None, least_words: int) -> Iterator[tuple[int, int, int, str, list[bytes]]]:
    """(number of the first line, lines, start in code points, paragraph, words) of the paragraphs with enough words."""
    at = 0
    first, begin, short, gathered = 0, 0, [], []
    for number, line in enumerate([*text.split("\n"), ""] if text else ()):
        words = line.encode("utf-8", "replace").lower().split()
        if 0 < len(words) < least_words:
            if not short:
                first, begin = number, at
            short.append(line)
            gathered += words
        else:
            if len(gathered) >= least_words:
                yield first, len(short), begin, "\n".join(short), gathered
            short, gathered = [], []
            if words:
                yield number, 1, at, line, words
        at += len(line) + 1


def _some_paragraphs(batch: pa.RecordBatch, column: int, least_words: int) -> Iterator[list[tuple]]:
    """(row, number of the first line, lines, start, paragraph, words) of the paragraphs of a column of texts, some at a time."""
    found, held = [], 0
    for i in range(batch.num_rows):
        for paragraph in paragraphs(batch.column(column)[i].as_py(), least_words):
            found.append((i, *paragraph))
            held += len(paragraph[-1])
            if held >= TOGETHER:
                yield found
                found, held = [], 0
    if found:
        yield found


def _sets(found: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray]:
    words = hashes_of(list(chain.from_iterable(f[-1] for f in found)))
    return shingle_sets(words, np.array([len(f[-1]) for f in found]), width)


def _profiles(width: int, least_words: int, bands: int, rows: int):
    names = ["id", "para", "lines", "start", "length", "node", "check", "n", *SKETCH, "sigs"]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = MinHash(bands, rows), set()
        for batch in batches:
            for found in _some_paragraphs(batch, 1, least_words):
                shingles, sizes = _sets(found, width)
                digests = set_digests(shingles, sizes)
                new = np.zeros(len(found), dtype=bool)
                for i, digest in enumerate(map(tuple, digests.tolist())):
                    if digest not in seen:
                        if len(seen) >= MAX_SEEN:
                            seen.clear()
                        seen.add(digest)
                        new[i] = True
                sigs = np.empty(0, dtype=np.uint64)
                if new.any():
                    sigs = hasher.signatures(shingles[np.repeat(new, sizes)], sizes[new]).reshape(-1)
                ends = pa.array(np.append(0, np.cumsum(new * bands)), pa.int32())
                places = np.array([(number, lines, start, len(line)) for _, number, lines, start, line, _ in found], dtype=np.int64)
                table = np.concatenate([places, digests, sizes[:, None], parity_sketches(shingles, sizes)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))]
                    + [pa.array(table[:, j]) for j in range(7 + SKETCH_WORDS)]
                    + [pa.ListArray.from_arrays(ends, pa.array(sigs.view(np.int64)))],
                    names=names,
                )

    return profile


def _lines(width: int, least_words: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _some_paragraphs(batch, 0, least_words):
                digests = set_digests(*_sets(found, width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests[:, 0]), pa.array([f[-2] for f in found], pa.string())], names=["node", "text"]
                )

    return listed


def repeated_paragraphs(
    docs: DataFrame,
    num: int = 4,
    den: int = 5,
    width: int = WIDTH,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, para, lines, start, length, n_shingles, kept_id, kept_para): every paragraph to remove, and the one that stays for it.

    ``para`` counts lines from 0 and is the first of ``lines`` lines; ``start`` and ``length`` are code points of the text. Paragraphs link when the
    Jaccard similarity of their shingle sets is at least num / den; equal sets always link. Null and empty texts
    and shorter paragraphs give no row. Rows with a null id are left alone, since a removal could not name
    them; rows that repeat an id count as one document. Sets are told by 64 bits of a digest; should two sets ever share them,
    128 bits tell, and only the paragraphs of one of the two are considered. Other columns are not read.
    """
    return _repeated_paragraphs(docs, num, den, width, least_words, id_col, text_col, StagingScope(docs.sparkSession, "paragraphs"))


def _repeated_paragraphs(
    docs: DataFrame, num: int, den: int, width: int, least_words: int, id_col: str, text_col: str, scope: StagingScope
) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull())
    kind = dict(texts.dtypes)["id"]
    numbers = ", ".join(f"`{c}` long" for c in ["para", "lines", "start", "length", "node", "check", "n", *SKETCH])
    bands, rows = bands_for(num / den)
    signed = scope.stage(
        texts.mapInArrow(_profiles(width, least_words, bands, rows), f"id {kind}, {numbers}, sigs array<long>"), "signed"
    )
    placed = signed.drop("sigs")
    # Sketches stay where they are: most sets are in no candidate pair, and a struct of twenty numbers is slow to aggregate.
    nodes = scope.stage(
        placed.groupBy("node").agg(F.min(F.struct("check", "id")).alias("f")).select(
            "node", F.col("node").alias("same_as"), F.col("f.check").alias("check"), F.col("f.id").alias("at")
        ),
        "nodes",
    )
    scope.release()
    members = signed.select(F.explode("sigs").alias("sig"), "node")

    def sketches_of(ids: DataFrame) -> DataFrame:
        asked = nodes.join(ids, "node", "left_semi").select("node", F.col("at").alias("id"), F.col("check").alias("_check"))
        found = placed.select("node", "id", "check", "n", *SKETCH).join(asked, ["node", "id"])  # one document a node: no key is hot
        return found.filter(F.col("check") == F.col("_check")).select("node", "n", *SKETCH).dropDuplicates(["node"])

    def texts_of(ids: DataFrame) -> DataFrame:
        where = scope.stage(
            nodes.join(ids, "node", "left_semi").select(F.col("at").alias("id")).distinct(), f"asked-{uuid4().hex}"
        )
        found = lookup_join(texts, where, "id", "left_semi").select("text").mapInArrow(
            _lines(width, least_words), "node long, text string"
        )
        return lookup_join(found, ids, "node", "left_semi").dropDuplicates(["node"])

    linked = similar_components(members, nodes, sketches_of, texts_of, width, num, den, scope, "paras")
    known = placed.groupBy("node", "check").agg(F.count("*").alias("copies"))
    group = nodes.select("node", "check").join(linked, "node", "left").join(known, ["node", "check"])
    # A paragraph matters if its set has several copies or links with another set.
    group = scope.stage(
        group.filter((F.col("copies") > 1) | F.col("component").isNotNull()).select(
            "node", "check", F.coalesce("component", "node").alias("component"), "copies"
        ),
        "groups",
    )
    scope.release()
    group = group.withColumnRenamed("check", "_check")
    places = lookup_join(placed, group, "node", "inner", "copies", F.hash("id", "para"))
    places = scope.stage(
        places.filter(F.col("check") == F.col("_check")).select("id", "para", "lines", "start", "length", "n", "component"), "places"
    )
    scope.release("signed", "nodes", "groups")  # nothing reads the profiles any more
    kept = places.groupBy("component").agg(F.min(F.struct("id", "para")).alias("k"), F.count("*").alias("rows"))
    kept = scope.stage(kept.select("component", F.col("k.id").alias("kept_id"), F.col("k.para").alias("kept_para"), "rows"), "kept")
    told = lookup_join(places, kept, "component", "inner", "rows", F.hash("id", "para"))
    return told.filter((F.col("id") != F.col("kept_id")) | (F.col("para") != F.col("kept_para"))).select(
        F.col("id").alias(id_col), "para", "lines", "start", "length", F.col("n").alias("n_shingles"), "kept_id", "kept_para"
    )


def run_hashes(words: np.ndarray, run: int, base: int) -> np.ndarray:
    """Hash of every ``run`` consecutive words, from differences of one running sum."""
    n = len(words)
    if n < run:
        return np.empty(0, dtype=np.uint64)
    powers = np.multiply.accumulate(np.full(n, base, dtype=np.uint64))
    back = np.multiply.accumulate(np.full(n - run + 1, pow(base, -1, 1 << 64), dtype=np.uint64))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
    return mixed((total[run:] - total[:-run]) * back)


def _sliding(op: Callable, values: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values, size = op(values[:-size], values[size:]), 2 * size
    return op(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(hashes: np.ndarray, width: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """Places that hold the smallest value of some ``width`` neighbours: the choice depends on these neighbours alone.

    ``lengths`` cuts the hashes into stretches (default: one), and neighbours are those of one stretch.
    """
    if len(hashes) < width:
        return np.empty(0, dtype=np.int64)
    lengths = np.array([len(hashes)]) if lengths is None else lengths
    pad = np.zeros(width - 1, dtype=np.uint64)
    after = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(hashes))  # places from here to the end of the stretch
    lowest = np.where(after[: len(hashes) - width + 1] >= width, _sliding(np.minimum, hashes, width), np.uint64(0))
    highest = _sliding(np.maximum, np.concatenate([pad, lowest, pad]), width)
    return np.flatnonzero((highest == hashes) & np.repeat(lengths >= width, lengths))


def _anchor_rows(run: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in some_texts(batch, 1):
                words = TextWords(texts)
                runs, place = words.runs(gram)
                if not len(place):
                    continue
                hashes = run_hashes(words.hashes, gram, BASES[0])[place]
                chosen = anchors(hashes, run - gram + 1, runs)
                at = place[chosen]
                owner = words.owner[at]
                line = words.lines()
                table = [hashes[chosen].view(np.int64), at - words.before[owner], line[at], line[at + gram - 1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), *map(pa.array, table)], names=["id", "hash", "at", "line", "last"]
                )

    return rows


def _run_rows(run: int, gram: int):
    """Runs around the anchors of a text, outside its removed lines."""

    def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Number of the row of every entry of lists, and the entries."""
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(lists)), sizes), lists.flatten()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in some_texts(batch, 1):
                words = TextWords(texts)
                runs, place = words.runs(run)
                if not len(place):
                    continue
                whole = len(words.hashes) + 1
                text, entries = flat(part.column(2))
                at = entries.to_numpy(zero_copy_only=False)
                own = at - run + gram < runs[text]
                text, at = text[own], at[own]
                low, high = np.maximum(at - run + gram, 0), np.minimum(at + 1, runs[text])
                near = np.cumsum(_steps(words.before[text] + low, words.before[text] + high, whole)) > 0
                text, entries = flat(part.column(3))
                line = words.lines()
                lines, first = words.owner << 40 | line, text << 40 | entries.field("para").to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(lines, first), np.searchsorted(lines, first + entries.field("lines").to_numpy(zero_copy_only=False))
                removed = np.cumsum(_steps(low, high, whole)) > 0
                gone = np.concatenate([[0], np.cumsum(removed)])
                at = place[near[place] & (gone[place + run] == gone[place])]
                if not len(at):
                    continue
                numbers = [run_hashes(words.hashes, run, b)[at].view(np.int64) for b in BASES]
                owner = words.owner[at]
                start, end = words.spans()
                numbers += [at - words.before[owner], line[at], start[at], end[at + run - 1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), *map(pa.array, numbers)],
                    names=["id", "hash", "check", "at", "line", "start", "end"],
                )

    return rows


def _steps(low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """What the number of open intervals [low, high) changes by at every place."""
    return np.bincount(low, minlength=size) - np.bincount(high, minlength=size)


def repeated_passages(
    docs: DataFrame,
    removals: DataFrame,
    run: int = RUN,
    gram: int = GRAM,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Passages of at least ``run`` words that stand earlier too, word for word, in what ``removals`` leaves; columns as there.

    Line ends and case do not count, and a passage does not reach across a removed paragraph. ``lines`` is 0, since
    ``start`` and ``length`` bound the passage inside its lines; ``para`` is the line it begins in, and ``kept_para`` that
    of the first copy. All runs are found: of the hashes of ``gram`` words in a run some are anchors by the run's own
    words alone, so two equal runs share one. Runs around repeated anchors are told by 128 bits, the
    first of each stays, the others are merged. A copy that overlaps the first one stays. Null ids, repeated ids and null
    texts as in ``repeated_paragraphs``.
    """
    return _repeated_passages(docs, removals, run, gram, width, id_col, text_col, StagingScope(docs.sparkSession, "passages"))


def _repeated_passages(
    docs: DataFrame, removals: DataFrame, run: int, gram: int, width: int, id_col: str, text_col: str, scope: StagingScope
) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull())
    kind = dict(texts.dtypes)["id"]
    gone = scope.stage(
        removals.groupBy(F.col(id_col).alias("id")).agg(F.collect_set(F.struct("para", "lines")).alias("gone")), "gone"
    )
    numbers = "hash long, at long, line long, last long"
    found = scope.stage(texts.mapInArrow(_anchor_rows(run, gram), f"id {kind}, {numbers}"), "anchors")

    def repeated(rows: DataFrame, label: str) -> DataFrame:
        """The rows whose hash stands at several places."""
        place = F.struct("id", "at")
        counted = rows.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("copies"))
        several = scope.stage(counted.filter(F.col("low") != F.col("high")).select("hash", "copies"), label)
        return lookup_join(rows, several, "hash", "inner", "copies", F.hash("id", "at")).drop("copies")

    inside = F.exists("gone", lambda g: (g["para"] <= F.col("last")) & (g["para"] + g["lines"] > F.col("line")))
    left = lookup_join(repeated(found, "repeated"), gone, "id", "left").filter(~F.coalesce(inside, F.lit(False)))
    left = scope.stage(left.select("id", "hash", "at"), "left")
    scope.release("anchors", "repeated")
    marks = repeated(left, "repeated-left").groupBy("id").agg(F.collect_set("at").alias("anchors"))
    marks = scope.stage(lookup_join(marks, gone, "id", "left"), "marks")
    scope.release("left", "repeated-left")
    numbers = ", ".join(f"`{c}` long" for c in ["hash", "check", "at", "line", "start", "end"])
    marked = lookup_join(texts, marks, "id").select("id", "text", "anchors", "gone")
    runs = scope.stage(marked.mapInArrow(_run_rows(run, gram), f"id {kind}, {numbers}"), "runs")
    scope.release("marks")
    first = runs.groupBy("hash", "check").agg(F.min(F.struct("id", "at", "line")).alias("f"), F.count("*").alias("copies"))
    first = scope.stage(first.filter(F.col("copies") > 1).withColumnRenamed("check", "_check"), "first")
    scope.release()
    later = lookup_join(runs, first, "hash", "inner", "copies", F.hash("id", "at")).filter(
        (F.col("check") == F.col("_check")) & ((F.col("id") != F.col("f.id")) | (F.col("at") >= F.col("f.at") + run))
    )
    ordered = Window.partitionBy("id", "kept_id").orderBy("at")  # runs of one document
    later = later.select("id", "at", "line", "start", "end", F.col("f.id").alias("kept_id"), F.col("f.line").alias("kept_line"))
    begins = F.coalesce(F.col("at") > F.lag("at").over(ordered) + 1, F.lit(True)).cast("long")
    numbered = later.withColumn("begins", begins).withColumn("passage", F.sum("begins").over(ordered))
    return numbered.groupBy("id", "kept_id", "passage").agg(
        F.min("line").alias("para"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max("at") - F.min("at") + run - width + 1).alias("n_shingles"), F.min_by("kept_line", "at").alias("kept_para"),
    ).select(
        F.col("id").alias(id_col), "para", F.lit(0).cast("long").alias("lines"), "start",
        (F.col("end") - F.col("start")).alias("length"), "n_shingles", "kept_id", "kept_para",
    )


def repeated_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All removals: near copies of paragraphs, then repeated passages of what they leave."""
    scope, own = (StagingScope(docs.sparkSession, name) for name in ("repeated", "paragraphs"))
    found = _repeated_paragraphs(docs, 4, 5, WIDTH, LEAST_WORDS, id_col, text_col, own)
    removals = scope.stage(found, "paragraphs")
    own.clear()
    scope.release()
    return removals.unionByName(repeated_passages(docs, removals, id_col=id_col, text_col=text_col))


def _without(text: str | None, gone: list | None) -> str | None:
    """The text without the removed lines and passages."""
    if text is None or not gone:
        return text
    lines = {k for g in gone for k in range(g["para"], g["para"] + g["lines"])}
    cuts = sorted((g["start"], g["start"] + g["length"]) for g in gone if not g["lines"])
    kept, at, k = [], 0, 0
    for number, line in enumerate(text.split("\n")):
        end = at + len(line)
        while k < len(cuts) and cuts[k][1] <= at:
            k += 1
        if number not in lines:
            pieces, low, j = [], at, k
            while j < len(cuts) and cuts[j][0] < end:
                pieces.append(text[low : max(low, cuts[j][0])])
                low, j = max(low, min(cuts[j][1], end)), j + 1
            shorter = "".join([*pieces, text[low:end]])
            if shorter or shorter == line:  # a line that a passage fills goes with it
                kept.append(shorter)
        at = end + 1
    return "\n".join(kept)


def remove_paragraphs(docs: DataFrame, removals: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the removed lines and passages; texts without any are unchanged, and the other columns stay."""
    places = F.collect_set(F.struct("para", "lines", "start", "length"))
    gone = removals.groupBy(F.col(id_col).alias("_id")).agg(places.alias("_gone"))
    text = F.col("row").getField(text_col)
    joined = docs.select(whole_row(docs), F.col(id_col).alias("_id")).join(gone, "_id", "left")
    shorter = F.when(F.col("_gone").isNull(), text).otherwise(F.udf(_without, "string")(text, "_gone"))
    return joined.select(F.col("row").withField(f"`{text_col}`", shorter).alias("row")).select("row.*")
