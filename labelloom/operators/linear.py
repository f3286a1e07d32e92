"""Multinomial logistic regression on sparse rows: vector-free L-BFGS over coefficient parts, and blocked scoring.

Coefficients, gradients and the history of the optimiser are tables with one row per *part*, a range of terms, that holds
a (columns x terms) matrix. Part -1 is the intercepts. The driver sees dot products, losses and the
largest gradient entry, and coefficients only where they are small. Rows are packed into blocks of bounded size, whose entries are grouped
by part. A step of the optimiser is one pass over the rows:

1. each part of the state, which holds the coefficients, the gradient and the history, gives the coefficients after a step of the
   length at hand; they meet the blocks, whose margins, losses and partial gradients follow in one go and are added up per part;
2. the driver reads the loss, takes the step or shortens it; a step that is taken gives the new state, part by part, together
   with the dot products of its new vectors with the old ones.

Margins are computed anew rather than kept: kept ones would be shuffled and written in every step, and grow with the rows. The
history stays in the row of its part, so that it is not shuffled; only partial gradients are.

Where a vector is known to be small (:meth:`Layout.is_held`), the same parts of the state lie in the driver's memory instead of a table:
coefficients go out once a step, summed gradients come back, and a step is one job that writes no table. The steps are the same.

Several models can be fitted in one pass: their columns lie side by side, and each has a penalty, class weights, a set of
terms and a step of its own. A model whose gradient is small enough stands still while the others go on, and one whose step is
shortened tries again beside the next step of the others.

The fitted objective of a model is ``sum(w * loss) / sum(w) + |coefficients|^2 / (2 * c * sum(w))``, intercepts not
penalised, which is the summed objective with penalty c divided by the sum of the weights.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.scale.staging import StagingScope

# Functions of this module run inside tasks, so they travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART_BYTES = 2 << 20  # of one part of one vector
BLOCK_DOCS, BLOCK_ENTRIES = 2_048, 1_000_000
MAX_BROADCAST_BYTES = 256 << 20  # a vector is broadcast only if its known size is at most this
HELD_BYTES = 32 << 20  # a vector of at most this known size is held by the driver, with those of the history
FLUSH_BYTES = 128 << 20  # partial gradients a task holds before it hands them on
MAX_MODELS = 64  # members of a term are the bits of one long
GROUP_BYTES = 32 << 20  # of one vector of models that take their steps together; one model may be larger
HISTORY = 4
HELD_THREADS = 8  # parts of a held state that are worked on at a time
RELEASED = 1  # steps after which the broadcasts, which the driver holds too, and the shuffle files of finished ones are let go
GATHERED = 1 << 16  # numbers gathered at a time for a sparse product
DECREASE, NOISE = 1e-4, 1e-7  # share of the slope a step must gain, and the share of the loss that single precision leaves open
SHORTEST = 1e-3, 1e-6  # step lengths at which a model lets go of its history, and at which it stops
INTERCEPTS = -1
INTERCEPT_UNIT = 0.25  # steps are taken in intercepts of this unit, as theirs is the steepest direction; a power of two, so exact

BLOCK = "block long, n int, labels binary, norms binary, pieces array<struct<part:int,row:binary,at:binary,value:binary>>"


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _vector(values: np.ndarray) -> bytes:
    """Coefficients, gradients and history are stored in single precision; sums over them are double."""
    return np.ascontiguousarray(values, dtype=np.float32).tobytes()


def _read_vector(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(columns, -1)


def _table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


# --- blocks of rows -----------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How ``size`` terms are cut into parts of ``terms`` terms, for vectors of ``columns`` columns."""

    size: int
    columns: int
    terms: int

    @staticmethod
    def of(size: int, columns: int) -> Layout:
        """Parts of about ``PART_BYTES``."""
        return Layout(size, columns, max(16, PART_BYTES // (4 * columns)))

    @property
    def parts(self) -> int:
        return math.ceil(self.size / self.terms)

    def width(self, part: int) -> int:
        return 1 if part == INTERCEPTS else min(self.terms, self.size - part * self.terms)

    @property
    def vector_bytes(self) -> int:
        return (self.size + 1) * self.columns * 4

    def fits_broadcast(self) -> bool:
        return self.vector_bytes <= MAX_BROADCAST_BYTES

    def is_held(self) -> bool:
        return self.fits_broadcast() and self.vector_bytes <= HELD_BYTES


def _packing(layout: Layout, models: int, members, slots, precision):
    """Rows (label_id, indices, weights, payload) to blocks.

    ``members`` holds the models of each term as bits, if they differ, ``slots`` the slot and share of each term, if some share. Entries
    are stored as numbers of two bytes where rows and terms of a part are few enough, and weights in the given ``precision``.
    """
    place_of_term = np.uint16 if layout.terms <= 1 << 16 else np.int32

    def flush(number: int, labels: list, lengths: list, indices: list, weights: list, payload: list):
        n = sum(map(len, lengths))
        length, index, value = np.concatenate(lengths), np.concatenate(indices), np.concatenate(weights)
        row = np.repeat(np.arange(n, dtype=np.int32), length)
        norms = np.ones((models, n))
        if members is not None:
            bits = members.value[index]
            for m in range(models):
                own = (bits >> np.uint64(m)) & np.uint64(1) != 0
                norms[m] = np.sqrt(np.bincount(row[own], weights=value[own] ** 2, minlength=n))
            norms[norms == 0] = 1.0
        if slots is not None and len(index):
            slot, share = slots.value
            value = value * share[index]
            key, place = np.unique(slot[index] * np.int64(n) + row, return_inverse=True)
            value = np.bincount(place, weights=value)
            index, row = key // n, (key % n).astype(np.int32)
        order = np.argsort(index, kind="stable")
        index, row, value = index[order], row[order], value[order]
        part = index // layout.terms
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(part))
        pieces = [{"part": INTERCEPTS, "row": b"", "at": b"", "value": b""}]
        at, value = (index - part * layout.terms).astype(place_of_term), value.astype(precision)
        row = row.astype(np.uint16) if n <= 1 << 16 else row
        pieces += [{"part": int(part[a]), "row": _bytes(row[a:b]), "at": _bytes(at[a:b]), "value": _bytes(value[a:b])} for a, b in zip(starts, ends)]
        kind = pa.list_(pa.struct([("part", pa.int32()), ("row", pa.binary()), ("at", pa.binary()), ("value", pa.binary())]))
        columns = {
            "block": pa.array([TaskContext.get().partitionId() << 33 | number]),
            "n": pa.array([n], pa.int32()),
            "labels": pa.array([_bytes(np.concatenate(labels).astype(np.int32))], pa.binary()),
            "norms": pa.array([_bytes(norms)], pa.binary()),
            "pieces": pa.array([pieces], kind),
        }
        if payload:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, payload[0].schema) as writer:
                for batch in payload:
                    writer.write_batch(batch)
            columns["payload"] = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        return _table(columns)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, entries, held = 0, 0, 0, ([], [], [], [], [])
        for whole in batches:
            lists = whole.column(1)
            size = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, low = np.cumsum(size), 0
            while low < whole.num_rows:
                before = ends[low - 1] if low else 0
                room = np.searchsorted(ends, before + BLOCK_ENTRIES - entries, side="right")
                high = min(whole.num_rows, max(low + 1, min(low + BLOCK_DOCS - docs, int(room))))
                batch = whole.slice(low, high - low)
                held[0].append(batch.column(0).to_numpy(zero_copy_only=False))
                held[1].append(size[low:high])
                held[2].append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                held[3].append(batch.column(2).flatten().to_numpy(zero_copy_only=False))
                if whole.num_columns > 3:
                    held[4].append(pa.RecordBatch.from_arrays(batch.columns[3:], names=batch.schema.names[3:]))
                docs, entries, low = docs + high - low, entries + int(size[low:high].sum()), high
                if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES or low < whole.num_rows:
                    yield flush(number, *held)
                    number, docs, entries, held = number + 1, 0, 0, ([], [], [], [], [])
        if docs:
            yield flush(number, *held)

    return packed


def pack(arrays: DataFrame, layout: Layout, models: int = 1, members=None, slots=None, keep: tuple[str, ...] = (), precision=np.float64) -> DataFrame:
    """Blocks of (label_id, indices, weights) rows of unit length; ``keep`` names columns that travel with a block unread.

    A fit multiplies weights in single precision, so blocks that are packed for a fit alone may hold them so.
    """
    label = F.col("label_id") if "label_id" in arrays.columns else F.lit(0).alias("label_id")
    rows = arrays.select(label.cast("int").alias("label_id"), "indices", "weights", *keep)
    return rows.mapInArrow(_packing(layout, models, members, slots, precision), BLOCK + (", payload binary" if keep else ""))


# --- tasks ------------------------------------------------------------------------------


def _matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(columns, -1)


def _add_products(out: np.ndarray, key: np.ndarray, source: np.ndarray, value: np.ndarray, table: np.ndarray) -> None:
    """``out[key] += value * table[source]`` for entries sorted by key.

    Keys are taken by the number of their entries, padded to a power of two, as many at a time as fit the processor's cache: one
    small matrix product each.
    """
    if not len(key):
        return
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.append(first, len(key)))
    target, level = key[first], np.ceil(np.log2(length)).astype(np.int64)
    for power in np.unique(level):
        wide = np.arange(1 << int(power))
        own = np.flatnonzero(level == power)
        step = max(1, GATHERED // (len(wide) * table.shape[1]))
        for low in range(0, len(own), step):
            some = own[low : low + step]
            inside = wide < length[some][:, None]
            at = np.where(inside, first[some][:, None] + wide, 0)
            weight = np.where(inside, value[at], 0.0).astype(table.dtype, copy=False)
            out[target[some]] += np.matmul(weight[:, None, :], table[source[at]])[:, 0]


def _entries(n: int, row: bytes, at: bytes, value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and weights of a piece of a block of ``n`` rows, in the precisions in which they were stored."""
    rows = np.frombuffer(row, np.uint16 if n <= 1 << 16 else np.int32)
    short, single = len(at) == 2 * len(rows), len(value) == 4 * len(rows)
    return rows, np.frombuffer(at, np.uint16 if short else np.int32), np.frombuffer(value, np.float32 if single else np.float64)


def _add_margins(out: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], table: np.ndarray) -> None:
    """Add sparse rows times a (terms, columns) part of a vector to (n, columns)."""
    row, at, value = entries
    order = np.argsort(row, kind="stable")  # rows of two bytes are sorted by their digits
    _add_products(out, row[order], at[order], value[order], table)


@dataclass(frozen=True)
class Models:
    """The models at hand, as numbers among those the blocks were packed for."""

    packed: int = 1
    picked: tuple[int, ...] = (0,)

    @property
    def count(self) -> int:
        return len(self.picked)

    def norms(self, data: bytes, n: int, columns: int) -> np.ndarray:
        """(columns, n): lengths by which a row's entries are divided, a model's columns alike."""
        own = np.frombuffer(data, np.float64).reshape(self.packed, n)[list(self.picked)]
        return np.repeat(own, columns // self.count, axis=0)

    def inside(self, bits: np.ndarray) -> np.ndarray:
        """(models, terms): whether a model knows a term."""
        return (bits[None] >> np.array(self.picked, dtype=np.uint64)[:, None]) & np.uint64(1) != 0


def _adding_margins(layout: Layout, models: Models, vectors: tuple[str, ...], carry: tuple[str, ...], finish=None, kind=np.float64):
    """Pieces (block, n, norms, part, row, at, value, vectors..., carry...) to margins, added up over a block's neighbouring pieces.

    A block's margins are (vectors x columns, n). ``finish`` gets (block, margins, n, norms, its carried columns, its pieces) where
    the task sees a block as a whole, and yields what is told; without it margins are told as they are. A task keeps the parts
    it has met, transposed and in the precision ``kind`` of the products, if all of them may be broadcast, else the last one.
    """
    columns, kept_parts = layout.columns, layout.fits_broadcast()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        block = total = shift = norms = kept = None
        n, pieces = 0, []

        def told() -> Iterator[pa.RecordBatch]:
            margins = total.T / np.tile(norms, (len(vectors), 1)) + shift
            if finish is None:
                yield _table({"block": pa.array([block]), "margins": pa.array([_bytes(margins)], pa.binary()), **kept})
            else:
                yield from finish(margins, n, norms, kept, pieces)

        for batch in batches:
            place = {name: i for i, name in enumerate(batch.schema.names)}

            def get(name: str, i: int):
                return batch.column(place[name])[i].as_py()

            for i in range(batch.num_rows):
                if get("block", i) != block:
                    if block is not None:
                        yield from told()
                    block, n, pieces = get("block", i), get("n", i), []
                    norms = models.norms(get("norms", i), n, columns)
                    total, shift = np.zeros((n, len(vectors) * columns)), np.zeros((len(vectors) * columns, 1))
                    kept = {c: batch.column(place[c]).slice(i, 1) for c in carry}
                part = get("part", i)
                if part not in tables:
                    data = [get(v, i) for v in vectors]
                    if data[0] is None:
                        continue
                    if not kept_parts:
                        tables.clear()
                    tables[part] = np.concatenate([_read_vector(d, columns) for d in data]).T.astype(kind, order="C")
                if part == INTERCEPTS:
                    shift += tables[part].T
                else:
                    entries = _entries(n, get("row", i), get("at", i), get("value", i))
                    _add_margins(total, entries, tables[part])
                    if finish is not None:
                        pieces.append((part, entries))
        if block is not None:
            yield from told()
        if finish is not None:
            yield from finish(None, 0, None, None, [])

    return added


def _joined(blocks: DataFrame, vectors: DataFrame, layout: Layout, carry: tuple[str, ...]) -> DataFrame:
    """Pieces of the blocks beside their parts of ``vectors`` (part and one column per vector)."""
    pieces = blocks.select("block", "n", "norms", *carry, F.inline("pieces"))
    return pieces.join(F.broadcast(vectors) if layout.fits_broadcast() else vectors, "part", "left")


def _margins(blocks: DataFrame, vectors: DataFrame, layout: Layout, models: Models, carry: tuple[str, ...] = ()) -> DataFrame:
    """(block, margins, carry...), several rows a block if its pieces were joined in different tasks."""
    names = tuple(c for c in vectors.columns if c != "part")
    fields = ", ".join(["block long", "margins binary", *[f"`{c}` {dict(blocks.dtypes)[c]}" for c in carry]])
    return _joined(blocks, vectors, layout, carry).mapInArrow(_adding_margins(layout, models, names, carry), fields)


def softmax(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (classes, n) and the log of their normaliser; one row of margins stands for two classes."""
    if len(margins) == 1:
        margins = np.concatenate((np.zeros_like(margins), margins))
    top = margins.max(axis=0)
    raised = np.exp(margins - top)
    total = raised.sum(axis=0)
    return raised / total, np.log(total) + top


@dataclass(frozen=True)
class Problem:
    """Models to be fitted: penalties, class weights (models, classes), and the sum of the weights of their rows."""

    classes: int
    c: np.ndarray
    weights: np.ndarray
    total: np.ndarray
    which: Models

    @property
    def models(self) -> int:
        return len(self.c)

    def pick(self, models: list[int]) -> Problem:
        """The problem of some of the models, over the same blocks."""
        which = Models(self.which.packed, tuple(self.which.picked[m] for m in models))
        return Problem(self.classes, self.c[models], self.weights[models], self.total[models], which)

    @property
    def per_model(self) -> int:
        return 1 if self.classes == 2 else self.classes

    @property
    def columns(self) -> int:
        return self.models * self.per_model

    def wide(self, values: np.ndarray) -> np.ndarray:
        """One value a model to one row a column."""
        return np.repeat(values, self.per_model)[:, None]

    def residual(self, m: int, margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
        """Derivative of the mean loss by the margins of model ``m``, and the loss."""
        p, log_total = softmax(margins)
        w = self.weights[m][labels] / self.total[m]
        at = np.arange(len(labels))
        own = margins[labels, at] if self.classes > 2 else margins[0] * labels
        loss = float((w * (log_total - own)).sum())
        p = p.copy()
        p[labels, at] -= 1.0
        return (p if self.classes > 2 else p[1:]) * w, loss


class _Gradients:
    """Partial gradients (part, data), and the losses of the models beside the intercepts, added up over the blocks of a task."""

    def __init__(self, problem: Problem, layout: Layout) -> None:
        self.problem, self.layout = problem, layout
        self.held: dict[int, np.ndarray] = {}
        self.losses = np.zeros(problem.models)

    def add(self, margins: np.ndarray, labels: np.ndarray, norms: np.ndarray, pieces) -> None:
        k = self.problem.per_model
        found = [self.problem.residual(m, margins[m * k : (m + 1) * k], labels) for m in range(self.problem.models)]
        residual = np.concatenate([own for own, _ in found])
        self.losses += [loss for _, loss in found]
        scaled = np.ascontiguousarray((residual / norms).T, dtype=np.float32)
        self._of(INTERCEPTS)[:] += residual.sum(axis=1)
        for part, (row, at, value) in pieces:
            _add_products(self._of(part), at, row, value, scaled)

    def _of(self, part: int) -> np.ndarray:
        if part not in self.held:
            self.held[part] = np.zeros((self.layout.width(part), self.problem.columns))
        return self.held[part]

    def told(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """What is held, if it is more than ``least`` bytes."""
        if sum(data.nbytes for data in self.held.values()) > least:
            # Term by term: terms that the task's rows do not hold are runs of zeros, which compress.
            for part, data in self.held.items():
                losses = _bytes(self.losses) if part == INTERCEPTS else None
                yield _table({"part": pa.array([part], pa.int32()), "data": pa.array([_vector(data)], pa.binary()), "loss": pa.array([losses], pa.binary())})
            self.held, self.losses = {}, np.zeros(self.problem.models)


def _partial_gradients(problem: Problem, layout: Layout):
    """For whole blocks, and for blocks (n, labels, norms, pieces) joined with their margins m (none: zero)."""

    def whole():
        sums = _Gradients(problem, layout)

        def finish(margins, n, norms, kept, pieces) -> Iterator[pa.RecordBatch]:
            if margins is None:
                yield from sums.told()
            else:
                sums.add(margins, np.frombuffer(kept["labels"][0].as_py(), np.int32), norms, pieces)
                yield from sums.told(FLUSH_BYTES)

        return finish

    def streamed(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        yield from make(whole())(batches)

    def told_margins(row: dict, norms: np.ndarray, pieces) -> np.ndarray:
        return np.zeros((problem.columns, row["n"])) if row["m"] is None else _matrix(row["m"], problem.columns)

    return streamed, _over_blocks(problem, layout, told_margins)


def _over_blocks(problem: Problem, layout: Layout, margins: Callable):
    """Partial gradients of whole blocks (n, labels, norms, pieces, ...), whose ``margins`` follow from the row, its norms and pieces."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Gradients(problem, layout)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                norms = problem.which.norms(row["norms"], row["n"], problem.columns)
                pieces = [(p["part"], _entries(row["n"], p["row"], p["at"], p["value"])) for p in row["pieces"] if p["part"] != INTERCEPTS]
                sums.add(margins(row, norms, pieces), np.frombuffer(row["labels"], np.int32), norms, pieces)
                yield from sums.told(FLUSH_BYTES)
        yield from sums.told()

    return over


def _sent_margins(problem: Problem, sent):
    """Margins of a block by the coefficients that were sent out, by part as (terms, columns); at zero without them."""

    def margins(row: dict, norms: np.ndarray, pieces) -> np.ndarray:
        total = np.zeros((row["n"], problem.columns))
        if sent is None:
            return total.T
        for part, entries in pieces:
            _add_margins(total, entries, sent.value[part])
        return total.T / norms + sent.value[INTERCEPTS].T

    return margins


def _added_up(columns: int):
    """Partial margins of a block to one row."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, 0.0
        for batch in batches:
            for row in batch.to_pylist():
                block, total = row["block"], total + _matrix(row["margins"], columns)
        yield _table({"block": pa.array([block]), "m": pa.array([_bytes(total)], pa.binary())})

    return added


def _summing(columns: int):
    """Partial gradients of whole parts, as they come, to one row (part, data, loss) a part."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, losses = {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = np.frombuffer(row["data"], np.float32).reshape(-1, columns)
                if row["part"] in totals:
                    totals[row["part"]] += own
                else:
                    totals[row["part"]] = own.astype(np.float64)
                if row["loss"] is not None:
                    losses = np.frombuffer(row["loss"], np.float64) + (0.0 if losses is None else losses)
        for part, total in totals.items():
            told = [losses.tolist() if part == INTERCEPTS else None]
            yield _table(
                {"part": pa.array([part], pa.int32()), "data": pa.array([_vector(total.T)], pa.binary()), "loss": pa.array(told, pa.list_(pa.float64()))}
            )

    return summed


def _by_model(problem: Problem, values: np.ndarray) -> np.ndarray:
    return values.reshape(problem.models, -1).sum(axis=1)


def _unit(part: int) -> float:
    return INTERCEPT_UNIT if part == INTERCEPTS else 1.0


SUMS = "part int, data binary, loss array<double>"
STATE = "part int, w binary, g binary, past array<binary>, members binary, dots array<double>, top array<double>"


@dataclass(frozen=True)
class _Step:
    """A step of the models: the names of the vectors in ``past``, each stored vector's share in the direction, and the lengths."""

    problem: Problem
    layout: Layout
    older: list[str]
    shares: dict[str, np.ndarray]
    moved: np.ndarray

    def taken(self, row: dict) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """The stored vectors of a part, its step and its new coefficients, both rounded as they are stored."""
        wide, names = self.problem.wide, ["w", "g", *self.older]
        found = {name: _read_vector(d, self.problem.columns) for name, d in zip(names, (row["w"], row["g"], *row["past"]))}
        s = (wide(self.moved) * sum(wide(share) * found[name] for name, share in self.shares.items())).astype(np.float32)
        return found, s, found["w"] + s

    def moved_to(self, row: dict) -> np.ndarray:
        """A part's coefficients after the step."""
        return self.taken(row)[2] * _unit(row["part"])

    def moving(self):
        """Rows of the state to (part, coefficients after the step)."""
        return _each_row(lambda row: _table({"part": pa.array([row["part"]], pa.int32()), "w": pa.array([_vector(self.moved_to(row))], pa.binary())}))

    def stepped(self, row: dict) -> pa.RecordBatch:
        """A row of the state with the sums ``p`` over the rows at the new coefficients to the new state."""
        found, s, w = self.taken(row)
        g = np.where(self.problem.wide(self.moved) > 0, _gradient(self.problem, self.layout, row, w), found["g"])
        return _state(self.problem, row, {"w": w, "s": s, "y": g - found["g"], "g": g}, found, self.older)


def _each_row(made: Callable[[dict], pa.RecordBatch]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield made(batch.slice(i, 1).to_pylist()[0])

    return each


def _gradient(problem: Problem, layout: Layout, row: dict, w: np.ndarray) -> np.ndarray:
    part = row["part"]
    g = np.zeros((problem.columns, layout.width(part))) if row["p"] is None else _read_vector(row["p"], problem.columns).astype(np.float64)
    if part == INTERCEPTS:
        return g * INTERCEPT_UNIT
    g = g + w / problem.wide(problem.c * problem.total)
    if row["members"] is not None:
        g = g * np.repeat(problem.which.inside(np.frombuffer(row["members"], np.uint64)), problem.per_model, axis=0)
    return g


def _state(problem: Problem, row: dict, new: dict[str, np.ndarray], found: dict[str, np.ndarray], older: list[str] | None) -> pa.RecordBatch:
    """One row of the state; ``older`` names the vectors of its history, None where it begins."""
    double = {name: v.astype(np.float64) for name, v in found.items() if name in (older or [])}
    dots = []
    for a in new.values():
        dots += [_by_model(problem, np.vecdot(a, b, dtype=np.float64)) for b in (*[double[o] for o in older or []], *new.values())]
    past = [] if older is None else [*row["past"], _vector(new["s"]), _vector(new["y"])][-2 * HISTORY :]
    top = np.abs(new["g"]).max(axis=1).reshape(problem.models, -1).max(axis=1) / _unit(row["part"])
    return _table(
        {
            "part": pa.array([row["part"]], pa.int32()), "w": pa.array([_vector(new["w"])], pa.binary()), "g": pa.array([_vector(new["g"])], pa.binary()),
            "past": pa.array([past], pa.list_(pa.binary())), "members": pa.array([row["members"]], pa.binary()),
            "dots": pa.array([np.concatenate(dots).tolist()]), "top": pa.array([top.tolist()]),
        }
    )


def _beginning(problem: Problem, layout: Layout):
    """A row (part, w, members, p) to the state before the first step; without ``w`` at zero."""

    def begun(row: dict) -> pa.RecordBatch:
        none = np.zeros((problem.columns, layout.width(row["part"])), dtype=np.float32)
        w = none if row["w"] is None else _read_vector(row["w"], problem.columns) / np.float32(_unit(row["part"]))
        return _state(problem, row, {"w": w, "s": none, "y": none, "g": _gradient(problem, layout, row, w)}, {}, None)

    return begun


# --- the optimiser ------------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """Coefficients (part, data), per model: steps taken, largest gradient entry, loss, whether the gradient ended the fit."""

    weights: DataFrame
    layout: Layout
    problem: Problem
    steps: np.ndarray
    gradient: np.ndarray
    loss: np.ndarray
    converged: np.ndarray
    scope: StagingScope

    def clear(self) -> None:
        """Delete the coefficients."""
        self.scope.clear()


class _History:
    """Dot products of the coefficients, the gradient and the stored steps, and the two-loop recursion over them."""

    def __init__(self, models: int) -> None:
        self.models, self.kept = models, []
        self.dots, self.penalised = {}, {}  # over all parts, and without the intercepts
        self.barred = np.full(models, -1)  # the last version that a model does not look back to

    def names(self) -> list[str]:
        return [f"{kind}{v}" for v in self.kept for kind in "sy"]

    def add(self, version: int, told: dict[int, list[float]]) -> None:
        """``told``: by part, the dot products of the new w, s, y and g with the names kept so far, then with w, s, y and g."""
        own = ["w", f"s{version}", f"y{version}", "g"]
        others = [*self.names(), *own]
        shape = len(own), len(others), self.models
        every = sum(np.array(d).reshape(shape) for d in told.values())
        for dots, values in ((self.dots, every), (self.penalised, every - np.array(told[INTERCEPTS]).reshape(shape))):
            for a, row in zip(own, values):
                for b, value in zip(others, row):
                    dots[a, b] = dots[b, a] = value
        self.kept.append(version)

    def forget(self, most: int = HISTORY) -> None:
        while len(self.kept) > most:
            gone = self.kept.pop(0)
            for dots in (self.dots, self.penalised):
                for key in [k for k in dots if f"s{gone}" in k or f"y{gone}" in k]:
                    del dots[key]

    def lengths(self, share: dict[str, np.ndarray]) -> list[np.ndarray]:
        """Of the penalised coefficients w and a direction d: w.w, w.d and d.d."""
        wd = sum(part * self.penalised["w", a] for a, part in share.items())
        dd = sum(p * q * self.penalised[a, b] for a, p in share.items() for b, q in share.items())
        return [self.penalised["w", "w"], wd, dd]

    def looks_back(self) -> np.ndarray:
        return np.array([any(v > b for v in self.kept) for b in self.barred])

    def slope(self, share: dict[str, np.ndarray]) -> np.ndarray:
        return sum(part * self.dots[kind, "g"] for kind, part in share.items())

    def direction(self, first: np.ndarray) -> dict[str, np.ndarray]:
        """Share of every stored vector in the quasi-Newton direction; a pair without curvature in a model counts nothing there.

        ``first`` is the scale of the gradient for a model that has no such pair.
        """
        share = {name: np.zeros(self.models) for name in self.names()} | {"g": -np.ones(self.models)}
        curved = {v: self.dots[f"s{v}", f"y{v}"] for v in self.kept}
        good = {v: (curved[v] > 1e-12 * self.dots[f"y{v}", f"y{v}"] + 1e-300) & (v > self.barred) for v in self.kept}
        alpha = {}

        def along(name: str) -> np.ndarray:
            return sum(part * self.dots[kind, name] for kind, part in share.items())

        for v in reversed(self.kept):
            alpha[v] = np.where(good[v], along(f"s{v}") / np.where(good[v], curved[v], 1.0), 0.0)
            share[f"y{v}"] = share[f"y{v}"] - alpha[v]
        scale = first
        for v in self.kept:
            scale = np.where(good[v], curved[v] / np.maximum(self.dots[f"y{v}", f"y{v}"], 1e-300), scale)
        share = {kind: part * scale for kind, part in share.items()}
        for v in self.kept:
            beta = np.where(good[v], along(f"y{v}") / np.where(good[v], curved[v], 1.0), 0.0)
            share[f"s{v}"] = share[f"s{v}"] + alpha[v] - beta
        return share


def fit(
    blocks: DataFrame, layout: Layout, problem: Problem, tol: float, max_iter: int, members: DataFrame | None = None, start: DataFrame | None = None
) -> Fit:
    """Fit all models of ``problem`` on staged ``blocks`` until every gradient entry is at most ``tol`` in size.

    ``members`` (part, data) holds the models of each term as bits, if they differ; ``start`` (part, data) coefficients
    to begin with, else zero; those of terms that a model does not know are taken as zero. A fit ends at ``max_iter`` steps, or where no trial step brings a model further; ``converged`` says
    which models ended by their gradient.
    """
    if problem.models > MAX_MODELS:
        raise ValueError(f"at most {MAX_MODELS} models are fitted together")
    scope = StagingScope(blocks.sparkSession, "lbfgs")
    if blocks.storageLevel.useDisk:
        return _fit(blocks, layout, problem, tol, max_iter, members, start, scope)
    blocks = placed(blocks)
    try:
        return _fit(blocks, layout, problem, tol, max_iter, members, start, scope)
    finally:
        blocks.unpersist()


def placed(blocks: DataFrame) -> DataFrame:
    """Staged blocks kept by block on the executors' disks, for any number of fits; lost ones are read anew.

    They are cut into ranges of about as many blocks each, so that no task of a step waits for one with more.
    """
    count, cores = blocks.count(), blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.repartitionByRange(max(1, min(count, max(cores, count // 32))), "block").persist(StorageLevel.DISK_ONLY)


def _known(problem: Problem, row: dict) -> bytes | None:
    """The coefficients a part begins with, without those of terms that a model does not know."""
    if row["w"] is None or row["members"] is None:
        return row["w"]
    inside = problem.which.inside(np.frombuffer(row["members"], np.uint64))
    return _vector(np.where(np.repeat(inside, problem.per_model, axis=0), _read_vector(row["w"], problem.columns), 0.0))


class _Tables:
    """The state of a fit as a table with a row per part; only numbers reach the driver."""

    def __init__(self, blocks: DataFrame, layout: Layout, problem: Problem, members: DataFrame | None, start: DataFrame | None, scope: StagingScope) -> None:
        self.blocks, self.layout, self.problem, self.scope = blocks, layout, problem, scope
        self.started, self.tries, self.version = start is not None, 0, 0
        spark, parts = blocks.sparkSession, [INTERCEPTS, *range(layout.parts)]
        # Every part is there, also one that no row of the blocks holds.
        begun = spark.createDataFrame([(p,) for p in parts], "part int")
        for table, column in ((start, "w"), (members, "members")):
            if table is None:
                begun = begun.withColumn(column, F.lit(None).cast("binary"))
            else:
                begun = begun.join(table.select("part", F.col("data").alias(column)), "part", "left")
        begun = begun.repartition(min(len(parts), spark.sparkContext.defaultParallelism), "part").select("part", "w", "members")

        def cleared(row: dict) -> pa.RecordBatch:
            held = {"w": _known(problem, row), "members": row["members"]}
            return _table({"part": pa.array([row["part"]], pa.int32())} | {name: pa.array([data], pa.binary()) for name, data in held.items()})

        self.state = begun.mapInArrow(_each_row(cleared), "part int, w binary, members binary") if self.started else begun

    def _summed(self, weights: DataFrame | None, label: str) -> DataFrame:
        """(part, data, loss): gradients and losses over the rows at the coefficients ``weights`` (part, w), at zero without them."""
        blocks, layout, problem = self.blocks, self.layout, self.problem
        streamed, joined = _partial_gradients(problem, layout)
        told = "part int, data binary, loss binary"

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return streamed(batches, lambda finish: _adding_margins(layout, problem.which, ("w",), ("labels",), finish, np.float32))

        if weights is not None and layout.fits_broadcast():
            partial = _joined(blocks, weights, layout, ("labels",)).mapInArrow(added, told)
        else:
            rows = blocks.withColumn("m", F.lit(None).cast("binary"))
            if weights is not None:
                sums = _margins(blocks, weights, layout, problem.which).groupBy("block").applyInArrow(_added_up(layout.columns), "block long, m binary")
                rows = blocks.join(sums, "block")
            partial = rows.select("n", "labels", "norms", "pieces", "m").mapInArrow(joined, told)
        return self.scope.stage(partial.groupBy("part").applyInArrow(_summing(layout.columns), SUMS), label)

    def _beside(self, sums: DataFrame) -> DataFrame:
        sums = sums.select("part", F.col("data").alias("p"))
        return self.state.join(F.broadcast(sums) if self.layout.fits_broadcast() else sums, "part", "left")

    def _losses(self) -> np.ndarray:
        return np.array(self.sums.filter(F.col("part") == INTERCEPTS).select("loss").first()[0])

    def _numbers(self) -> tuple[dict[int, list[float]], np.ndarray]:
        told = self.state.select("part", "dots", "top").collect()
        return {r["part"]: r["dots"] for r in sorted(told)}, np.max([r["top"] for r in told], axis=0)

    def begin(self) -> tuple[np.ndarray, dict[int, list[float]], np.ndarray]:
        """Losses, dot products by part and largest gradient entries at the start."""
        self.sums = self._summed(self.state.select("part", "w") if self.started else None, "sums-0")
        self.state = self.scope.stage(self._beside(self.sums).mapInArrow(_each_row(_beginning(self.problem, self.layout)), STATE), "state-0")
        found = self._losses(), *self._numbers()
        self.scope.drop("sums-0")
        return found

    def tried(self, step: _Step) -> np.ndarray:
        """Losses after a step."""
        self.tries += 1
        self.sums = self._summed(self.state.mapInArrow(step.moving(), "part int, w binary"), f"sums-{self.tries}")
        return self._losses()

    def take(self, step: _Step) -> tuple[dict[int, list[float]], np.ndarray]:
        """Take the step that was tried, or that of some models: its dot products by part and largest gradient entries."""
        self.version += 1
        self.state = self.scope.stage(self._beside(self.sums).mapInArrow(_each_row(step.stepped), STATE), f"state-{self.version}")
        self.scope.drop(f"state-{self.version - 1}")
        return self._numbers()

    def let_go(self) -> None:
        """Of what the last trial left."""
        self.scope.drop(f"sums-{self.tries}")
        if self.tries % RELEASED == 0:
            self.scope.release()

    def coefficients(self, still: _Step) -> DataFrame:
        return self.state.mapInArrow(still.moving(), "part int, w binary").select("part", F.col("w").alias("data"))


class _Held:
    """The same state in the driver's memory, for vectors of at most ``HELD_BYTES``: a step is one job, which writes no table.

    Coefficients go out as a broadcast; of the gradients each task sums up what it has, and parts are summed before they come back.
    """

    def __init__(self, blocks: DataFrame, layout: Layout, problem: Problem, members: DataFrame | None, start: DataFrame | None, scope: StagingScope) -> None:
        self.spark, self.layout, self.problem, self.scope = blocks.sparkSession, layout, problem, scope
        self.blocks = blocks.select("n", "labels", "norms", "pieces")
        self.started, self.tries = start is not None, 0
        known = [{} if t is None else {r["part"]: r["data"] for r in t.select("part", "data").toArrow().to_pylist()} for t in (start, members)]
        self.rows = [{"part": p, "w": known[0].get(p), "members": known[1].get(p), "p": None} for p in (INTERCEPTS, *range(layout.parts))]
        for row in self.rows:
            row["w"] = _known(problem, row)

    def _each(self, made: Callable[[dict], object]) -> list:
        with ThreadPoolExecutor(HELD_THREADS) as threads:
            return list(threads.map(made, self.rows))

    def _summed(self, coefficients: Callable[[dict], np.ndarray] | None) -> np.ndarray:
        """Put the sums over the rows beside the parts, as ``p``; the losses."""
        sent = None
        if coefficients is not None:
            tables = self._each(lambda row: np.ascontiguousarray(coefficients(row).T, dtype=np.float32))
            sent = self.spark.sparkContext.broadcast({row["part"]: table for row, table in zip(self.rows, tables)})
            del tables
        try:
            over = _over_blocks(self.problem, self.layout, _sent_margins(self.problem, sent))
            partial = self.blocks.mapInArrow(over, "part int, data binary, loss binary")
            dealt = partial.repartition(min(len(self.rows), self.spark.sparkContext.defaultParallelism), "part")
            told = {r["part"]: r for r in dealt.mapInArrow(_summing(self.layout.columns), SUMS).toArrow().to_pylist()}
        finally:
            if sent is not None:
                sent.destroy()
        for row in self.rows:
            row["p"] = told[row["part"]]["data"] if row["part"] in told else None
        return np.array(told[INTERCEPTS]["loss"])

    def _renewed(self, made: Callable[[dict], pa.RecordBatch]) -> tuple[dict[int, list[float]], np.ndarray]:
        self.rows = self._each(lambda row: made(row).to_pylist()[0])
        return {row["part"]: row["dots"] for row in self.rows}, np.max([row["top"] for row in self.rows], axis=0)

    def begin(self) -> tuple[np.ndarray, dict[int, list[float]], np.ndarray]:
        def started(row: dict) -> np.ndarray:
            return _read_vector(row["w"], self.problem.columns)

        losses = self._summed(started if self.started else None)
        return losses, *self._renewed(_beginning(self.problem, self.layout))

    def tried(self, step: _Step) -> np.ndarray:
        self.tries += 1
        return self._summed(step.moved_to)

    def take(self, step: _Step) -> tuple[dict[int, list[float]], np.ndarray]:
        return self._renewed(step.stepped)

    def let_go(self) -> None:
        if self.tries % RELEASED == 0:
            self.scope.release()

    def coefficients(self, still: _Step) -> DataFrame:
        data = pa.array([_vector(still.moved_to(row)) for row in self.rows], pa.binary())
        return self.spark.createDataFrame(pa.table({"part": pa.array([row["part"] for row in self.rows], pa.int32()), "data": data}))


def _fit(blocks, layout, problem, tol, max_iter, members, start, scope) -> Fit:
    state = (_Held if layout.is_held() else _Tables)(blocks, layout, problem, members, start, scope)
    history = _History(problem.models)
    losses, told, gradient = state.begin()
    history.add(0, told)
    history.forget(0)
    scale = problem.c * problem.total
    # The curvature of the loss by the margins is at most about 1 / classes at zero (1 / 4 for two), a row with its intercept at most 2.
    first = 1.0 / (2 * (0.25 if problem.per_model == 1 else 1.0 / problem.classes) + 1.0 / scale)
    loss = losses + history.penalised["w", "w"] / (2 * scale)
    taken, stuck, length = np.zeros(problem.models, dtype=int), np.zeros(problem.models, dtype=bool), np.ones(problem.models)
    version = 0
    while (active := (gradient > tol) & ~stuck & (taken < max_iter)).any():
        shares = history.direction(first)
        slope = history.slope(shares)
        moved = np.where(active, length, 0.0)
        step = _Step(problem, layout, history.names(), shares, moved)
        ww, wd, dd = history.lengths(shares)
        tried = state.tried(step) + (ww + 2 * moved * wd + moved * moved * dd) / (2 * scale)
        enough = active & (slope < 0) & (tried <= loss + DECREASE * moved * slope + NOISE * np.abs(loss))
        for m in np.flatnonzero(active & ~enough):
            # The least point of the parabola through both losses and the slope, within bounds.
            curve = tried[m] - loss[m] - length[m] * slope[m]
            best = -0.5 * length[m] * slope[m] / curve if np.isfinite(curve) and curve > 0 and slope[m] < 0 else 0.0
            length[m] *= min(0.5, max(0.1, best))
            if history.looks_back()[m] and (length[m] < SHORTEST[0] or slope[m] >= 0):
                history.barred[m], length[m] = version, 1.0  # it misleads: once more from the gradient alone
            stuck[m] = length[m] < SHORTEST[1]
        if enough.any():
            version += 1
            told, gradient = state.take(_Step(problem, layout, step.older, shares, np.where(enough, moved, 0.0)))
            history.add(version, told)
            history.forget()
            loss, length, taken = np.where(enough, tried, loss), np.where(enough, 1.0, length), taken + enough
        state.let_go()
    kept = StagingScope(blocks.sparkSession, "coefficients")
    weights = kept.stage(state.coefficients(_Step(problem, layout, [], {}, np.zeros(problem.models))), "weights")
    scope.clear()
    return Fit(weights, layout, problem, taken, gradient, loss, gradient <= tol, kept)


# --- scoring --------------------------------------------------------------------------------


def _finishing(per_model: int, models: int):
    """A block's margins to its rows, with the payload's columns before ``proba`` and ``best``."""

    def rows_of(margins: np.ndarray, payload: bytes) -> pa.RecordBatch:
        kept = pa.ipc.open_stream(payload).read_all().combine_chunks()
        kept = kept.to_batches()[0]
        proba, best = [], []
        for m in range(models):
            p, _ = softmax(margins[m * per_model : (m + 1) * per_model])
            proba.append(p)
            best.append(p.argmax(axis=0).astype(np.int32))
        proba, best = np.concatenate(proba).T, np.stack(best, axis=1)
        lists = [
            pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1))) for x in (proba, best)
        ]
        return pa.RecordBatch.from_arrays([*kept.columns, *lists], names=[*kept.schema.names, "proba", "best"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield rows_of(_matrix(row["margins"], per_model * models), row["payload"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, payload = 0.0, None
        for batch in batches:
            for row in batch.to_pylist():
                total, payload = total + _matrix(row["margins"], per_model * models), row["payload"]
        yield rows_of(total, payload)

    return finished, grouped


def pick_models(weights: DataFrame, layout: Layout, per_model: int, models: list[int]) -> DataFrame:
    """Coefficients of some of the models side by side."""
    rows = np.concatenate([np.arange(m * per_model, (m + 1) * per_model) for m in models])

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [_vector(_read_vector(d, layout.columns)[rows]) for d in batch.column(1).to_pylist()]
            yield _table({"part": batch.column(0), "data": pa.array(data, pa.binary())})

    return weights.select("part", "data").mapInArrow(picked, "part int, data binary")


def side_by_side(rows: DataFrame, per_model: int, order: list[int]) -> DataFrame:
    """Coefficients of several fits (part, data, at) as one vector a part; ``order`` picks its models, counted by ``at``."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["at"])
        for r in found:
            r["data"] = np.frombuffer(r["data"], np.float32).reshape(r["models"] * per_model, -1)
        whole = np.concatenate([r["data"] for r in found])
        picked = np.concatenate([whole[m * per_model : (m + 1) * per_model] for m in order])
        yield _table({"part": pa.array([found[0]["part"]], pa.int32()), "data": pa.array([_vector(picked)], pa.binary())})

    return rows.groupBy("part").applyInArrow(joined, "part int, data binary")


def score(
    arrays: DataFrame, weights: DataFrame, layout: Layout, per_model: int, models: Models = Models(), members=None, slots=None
) -> DataFrame:
    """The columns of ``arrays`` but ``indices`` and ``weights``, then ``proba`` (models x classes) and ``best`` (one index a model).

    Nothing runs before the result is read. If the coefficients may be broadcast (their size is known from the layout), a
    block's pieces meet them in one task; else pieces are joined by part and partial margins added up per block.
    """
    keep = tuple(c for c in arrays.columns if c not in ("indices", "weights"))
    # The payload is named by position, so no column of the table can clash with a name used here.
    inner = [f"_k{i}" for i in range(len(keep))]
    named = arrays.select("indices", "weights", *[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)])
    blocks = pack(named, layout, models.packed, members, slots, tuple(inner))
    kinds = dict(named.dtypes)
    schema = ", ".join([*[f"{i} {kinds[i]}" for i in inner], "proba array<double>", "best array<int>"])
    finished, grouped = _finishing(per_model, models.count)
    margins = _margins(blocks, weights.select("part", "data"), layout, models, ("payload",))
    if layout.fits_broadcast():
        rows = margins.mapInArrow(finished, schema)
    else:
        rows = margins.groupBy("block").applyInArrow(grouped, schema)
    return rows.select(*[F.col(i).alias(c) for i, c in zip(inner, keep)], "proba", "best")


def coefficients(spark: SparkSession, weights: DataFrame, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """The whole (columns, terms) matrix and the intercepts on the driver: for inspection of small models."""
    rows = {r["part"]: _read_vector(r["data"], layout.columns).astype(np.float64) for r in weights.collect()}
    return np.concatenate([rows[p] for p in range(layout.parts)], axis=1), rows[INTERCEPTS][:, 0]
