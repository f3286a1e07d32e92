"""TF-IDF + logistic regression: settings, fit, scoring, stored models and the majority baseline."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators import features as X
from labelloom.operators import linear as L
from labelloom.operators.prepare import fill_text
from labelloom.scale.joins import lookup_join
from labelloom.scale.staging import StagingScope

# Stack name, analyzers and default settings.
STACK_NAME = "tfidf_lr"
NEURAL_STACKS = ("bilstm", "bert", "distilbert")
DEFAULTS = {
    "max_features": 50_000,
    "analyzer": "word",
    "ngram_range": (1, 2),
    "min_df": 2,
    "max_df": 0.95,
    "c": 2.0,
    "class_weight": "balanced",
    "max_iter": 1000,
    "tol": 1e-4,
}


@dataclass(frozen=True)
class TextStack:
    """Settings of one TF-IDF + logistic regression stack."""

    max_features: int | None = DEFAULTS["max_features"]
    analyzer: str = DEFAULTS["analyzer"]
    ngram_range: tuple[int, int] = DEFAULTS["ngram_range"]
    min_df: int | float = DEFAULTS["min_df"]
    max_df: int | float = DEFAULTS["max_df"]
    c: float = DEFAULTS["c"]
    class_weight: str | None = DEFAULTS["class_weight"]
    max_iter: int = DEFAULTS["max_iter"]
    tol: float = DEFAULTS["tol"]  # largest entry of the gradient of the mean objective at which a fit ends

    def __post_init__(self) -> None:
        if self.analyzer not in X.ANALYZERS:
            raise ValueError(f"analyzer must be one of {X.ANALYZERS}")
        if self.class_weight not in ("balanced", None):
            raise ValueError("class_weight must be 'balanced' or None")
        object.__setattr__(self, "ngram_range", tuple(int(n) for n in self.ngram_range))


def build_stack(name: str, params: Mapping[str, Any] | None = None) -> TextStack:
    """Stack settings by name; unknown names and unknown settings raise."""
    if name in NEURAL_STACKS:
        raise ValueError(f"{name} is a neural stack; score its stored outputs with functions.scores instead")
    if name != STACK_NAME:
        raise ValueError(f"unknown stack: {name}")
    known = {f.name for f in fields(TextStack)}
    extra = set(params or {}) - known
    if extra:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return TextStack(**(params or {}))


@dataclass(frozen=True)
class FittedStack:
    """A fitted stack: settings, term vocabulary, label table, coefficient parts, and how the fit ended."""

    stack: TextStack
    vocab: X.TermVocabulary
    labels: DataFrame
    n_labels: int
    weights: DataFrame
    n_slots: int
    steps: int
    gradient: float
    converged: bool

    @property
    def per_model(self) -> int:
        return 1 if self.n_labels == 2 else self.n_labels

    @property
    def layout(self) -> L.Layout:
        return L.Layout.of(self.n_slots, self.per_model)

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        """The (columns, terms) matrix and the intercepts on the driver, to look at a small model."""
        own, intercepts = L.coefficients(self.weights.sparkSession, self.weights, self.layout)
        if self.vocab.slots is None:
            return own, intercepts
        slot, share = self.vocab.slots.value
        return own[:, slot] * share, intercepts


def with_terms(df: DataFrame, stack: TextStack, text: str, *keep: str) -> DataFrame:
    terms = X.analyze(F.col(text), stack.analyzer, stack.ngram_range)
    return fill_text(df, text).select(*keep, terms.alias("terms"))


@dataclass(frozen=True)
class JointFit:
    """Stacks fitted on one packed training table; ``distinct[i]`` is the model that stack ``i`` shares.

    ``fits`` holds the models that took their steps together, by their numbers in the table, and how each such fit ended.
    """

    stacks: list[TextStack]
    vocab: X.TermVocabulary
    sizes: list[int]
    distinct: list[int]
    labels: DataFrame
    n_labels: int
    fits: list[tuple[list[int], L.Fit]]
    members: Any = None

    def ended(self, i: int) -> tuple[int, float, bool]:
        models, fit = next(f for f in self.fits if self.distinct[i] in f[0])
        m = models.index(self.distinct[i])
        return int(fit.steps[m]), float(fit.gradient[m]), bool(fit.converged[m])

    def clear(self) -> None:
        """Delete the coefficients of all fits."""
        for _, fit in self.fits:
            fit.clear()


class TrainingTable:
    """Training rows (id, label, terms) packed once for any number of stacks with one analyzer and one range of n-grams.

    The vocabularies of the stacks are cuts of one table of term statistics. Rows are vectorised over their union; a stack's
    own rows are the same entries, those outside its vocabulary left out, scaled to unit length again. Stacks with
    equal vocabularies, penalties and class weights are one model. As many models take their steps together as have vectors of
    ``linear.GROUP_BYTES``, so what a step broadcasts, shuffles and writes does not grow with the number of stacks.
    """

    def __init__(self, terms: DataFrame, stats: DataFrame, n_docs: int, stacks: list[TextStack], id_column: str, label: str = "category") -> None:
        self.stacks, self.scope = stacks, StagingScope(terms.sparkSession, "training")
        vocab, self.sizes, cuts = _joint_vocabulary(stats, n_docs, stacks, self.scope)
        self.vocab, self.n_slots = X.shared_slots(vocab)
        self.labels = X.label_index(terms, label)
        counts = lookup_join(X.balanced_class_weights(terms, label), self.labels, label).orderBy("label_id").collect()
        self.n_labels = len(counts)
        if self.n_labels < 2:
            raise ValueError("at least two classes are needed")
        kinds: list[tuple[int, float, str | None]] = []
        self.distinct = []
        for cut, stack in zip(cuts, stacks):
            kind = (cut, stack.c, stack.class_weight)
            if kind not in kinds:
                kinds.append(kind)
            self.distinct.append(kinds.index(kind))
        rows = np.array([r["class_rows"] for r in counts], dtype=float)
        weights = np.array([[r["weight"] for r in counts] if w == "balanced" else np.ones(len(rows)) for _, _, w in kinds])
        c = np.array([c for _, c, _ in kinds])
        self.problem = L.Problem(self.n_labels, c, weights, weights @ rows, L.Models(len(c), tuple(range(len(c)))))
        together = max(1, min(len(c), L.GROUP_BYTES // (4 * self.problem.per_model * (self.n_slots + 1))))
        self.together = math.ceil(len(c) / math.ceil(len(c) / together))  # groups of about one size
        self.layout = L.Layout.of(self.n_slots, self.together * self.problem.per_model)
        self.members, self.member_parts = None, None
        if len({cut for cut, _, _ in kinds}) > 1:
            self.members, self.member_parts = self._members([cut for cut, _, _ in kinds])
        arrays = X.encode_labels(X.tfidf_transform(terms, self.vocab, id_column), self.labels, label)
        rows = arrays.select("label_id", "indices", "weights")
        packed = L.pack(rows, self.layout, self.problem.models, self.members, self.vocab.slots, precision=np.float32)
        self.blocks = L.placed(self.scope.stage(packed, "blocks"))

    def _members(self, cuts: list[int]):
        """Per term the models that know it, as bits, for the workers; the same per slot, as a table by part."""
        known = self.vocab.table.orderBy("term_id").select("cuts").toArrow()["cuts"].to_numpy()
        bits = np.zeros(self.vocab.size, dtype=np.uint64)
        for m, cut in enumerate(cuts):
            bits |= ((known >> cut) & 1).astype(np.uint64) << np.uint64(m)
        of_slot = bits
        if self.vocab.slots is not None:
            of_slot = np.zeros(self.n_slots, dtype=np.uint64)
            of_slot[self.vocab.slots.value[0]] = bits  # terms of a slot are known to the same models
        spark, n = self.vocab.table.sparkSession, self.layout.terms
        parts = [(p, bytes(of_slot[p * n : (p + 1) * n])) for p in range(self.layout.parts)]
        return spark.sparkContext.broadcast(bits), spark.createDataFrame(parts, "part int, data binary")

    def _fitted(
        self, models: list[int], max_iter: int | None, start: JointFit | None = None, after: Callable[[JointFit], None] | None = None
    ) -> JointFit:
        """Fit some of the models, a group at a time, to the smallest of the stacks' tolerances; ``after`` gets each group once fitted.

        A group that is fitted to the tolerance begins where the nearest models fitted before it ended: what ends a fit stays the same.
        """
        steps = max(s.max_iter for s in self.stacks) if max_iter is None else max_iter
        tol, fits = min(s.tol for s in self.stacks), []
        for low in range(0, len(models), self.together):
            own = models[low : low + self.together]
            problem = self.problem.pick(own)
            layout = L.Layout(self.n_slots, problem.columns, self.layout.terms)
            begun = None if start is None else self._start(start, own)
            near = [] if start is not None or max_iter is not None else self._nearest(own, [m for group, _ in fits for m in group])
            if near:
                begun = self._start(self._joint(fits), near)
            fits.append((own, L.fit(self.blocks, layout, problem, tol, steps, self.member_parts, begun)))
            if after is not None:
                after(self._joint(fits[-1:]))
        return self._joint(fits)

    def _nearest(self, models: list[int], fitted: list[int]) -> list[int]:
        """For each of the models one that was fitted before with its class weights, the one of the nearest penalty; empty if one has none."""
        own = self.problem.weights
        alike = {m: [f for f in fitted if np.array_equal(own[f], own[m])] for m in models}
        if not all(alike.values()):
            return []
        return [min(alike[m], key=lambda f: (abs(np.log(self.problem.c[f] / self.problem.c[m])), -f)) for m in models]

    def _joint(self, fits: list[tuple[list[int], L.Fit]]) -> JointFit:
        return JointFit(self.stacks, self.vocab, self.sizes, self.distinct, self.labels, self.n_labels, fits, self.members)

    def _start(self, joint: JointFit, models: list[int]) -> DataFrame:
        """Coefficients (part, data) of some of the models side by side, out of the fits that hold them."""
        k = self.problem.per_model
        held = [(models_of, fit) for models_of, fit in joint.fits if set(models_of) & set(models)]
        rows, order = None, [m for models_of, _ in held for m in models_of if m in models]
        for i, (models_of, fit) in enumerate(held):
            some = [models_of.index(m) for m in models_of if m in models]
            own = L.pick_models(fit.weights, fit.layout, k, some).withColumns({"at": F.lit(i), "models": F.lit(len(some))})
            rows = own if rows is None else rows.unionByName(own)
        return L.side_by_side(rows, k, [order.index(m) for m in models])

    def fit(self, max_iter: int | None = None, after: Callable[[JointFit], None] | None = None) -> JointFit:
        """All models."""
        return self._fitted(list(range(self.problem.models)), max_iter, after=after)

    def resume(
        self, joint: JointFit, models: list[int], max_iter: int | None = None, after: Callable[[JointFit], None] | None = None
    ) -> JointFit:
        """Go on with some of the models of an earlier fit, from its coefficients; the packed rows are used as they are."""
        return self._fitted(models, max_iter, joint, after)

    def clear(self) -> None:
        """Let the packed rows go."""
        self.blocks.unpersist()
        self.scope.clear()


def _joint_vocabulary(
    stats: DataFrame, n_docs: int, stacks: list[TextStack], scope: StagingScope
) -> tuple[X.TermVocabulary, list[int], list[int]]:
    """The union of the stacks' vocabularies with a column of bits, one per distinct cut; sizes; the cut of each stack.

    Cuts that differ in their limits but keep the same terms are one cut.
    """
    limits = [(s.min_df, s.max_df, s.max_features) for s in stacks]
    asked = list(dict.fromkeys(limits))
    tables = []
    for i, (low, high, most) in enumerate(asked):
        vocab = X.fit_vocabulary(stats, n_docs, min_df=low, max_df=high, max_features=most)
        digest = vocab.table.agg(F.bit_xor(F.xxhash64("term", F.lit(7)))).first()[0]
        tables.append((vocab, (vocab.size, digest)))
    distinct = list(dict.fromkeys(key for _, key in tables))
    chosen = [next(v for v, key in tables if key == d) for d in distinct]
    cut_of = {limit: distinct.index(key) for limit, (_, key) in zip(asked, tables)}
    cuts = [cut_of[limit] for limit in limits]
    sizes = [chosen[c].size for c in cuts]
    if len(chosen) == 1:
        return chosen[0], sizes, cuts
    union = None
    for i, vocab in enumerate(chosen):
        own = vocab.table.drop("term_id").withColumn("cuts", F.lit(1 << i).cast("long"))
        union = own if union is None else union.unionByName(own)
    same = [c for c in union.columns if c not in ("term", "cuts")]
    merged = union.groupBy("term").agg(*[F.first(c).alias(c) for c in same], F.bit_or("cuts").alias("cuts"))
    numbered = scope.stage(X.numbered_terms(merged, sum(v.size for v in chosen)), "union")
    return X.TermVocabulary(numbered, n_docs, numbered.count()), sizes, cuts


def fit_terms(
    terms: DataFrame, stats: DataFrame, n_docs: int, stack: TextStack, id_column: str, label: str = "category"
) -> FittedStack:
    """Fit on rows of (id, label, terms) whose term statistics are already known."""
    table = TrainingTable(terms, stats, n_docs, [stack], id_column, label)
    joint = table.fit()
    table.clear()
    return FittedStack(stack, joint.vocab, joint.labels, joint.n_labels, joint.fits[0][1].weights, table.n_slots, *joint.ended(0))


def fit_tfidf_lr(
    train: DataFrame, stack: TextStack, id_column: str, text: str, label: str = "category"
) -> FittedStack:
    """Term statistics, vocabulary, features and logistic regression over the training rows, whose text is tokenised once."""
    scope = StagingScope(train.sparkSession, "terms")
    terms = scope.stage(with_terms(train, stack, text, id_column, label), "terms")
    stats = scope.stage(X.term_stats(terms, id_column=id_column), "stats")
    fitted = fit_terms(terms, stats, terms.count(), stack, id_column, label)
    scope.clear()
    return fitted


def score_terms(fitted: FittedStack, terms: DataFrame, id_column: str) -> DataFrame:
    """Add ``proba`` and ``y_pred`` to rows that carry ``terms``; rows without known terms get the intercepts.

    Nothing runs before the result is read: the vocabulary was sent out with the fit or when the model was loaded.
    """
    arrays = X.tfidf_transform(terms, fitted.vocab, id_column)
    scored = L.score(arrays, fitted.weights, fitted.layout, fitted.per_model, slots=fitted.vocab.slots)
    scored = scored.withColumn("label_id", F.get("best", F.lit(0)))
    # Labels are fewer than coefficient rows, whose size the layout knows.
    named = fitted.labels.select("label_id", F.col("category").alias("y_pred"))
    out = scored.join(F.broadcast(named), "label_id", "left")
    return out.select(*[c for c in terms.columns if c != "terms"], "proba", "y_pred")


def predict_proba(
    fitted: FittedStack, df: DataFrame, id_column: str, text: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Class probabilities in label-id order, and the predicted label, per row; null texts score as empty."""
    return score_terms(fitted, with_terms(df, fitted.stack, text, id_column, *keep), id_column)


def predict(fitted: FittedStack, df: DataFrame, id_column: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predicted label per row: the most probable class, the lowest id on a tie."""
    return predict_proba(fitted, df, id_column, text, keep).drop("proba")


# The tables of a stored model.
_STORED = ("vocab", "labels", "weights")


def _digest(table: DataFrame) -> Column:
    """Rows, and a sum of row hashes that does not depend on their order."""
    return F.struct(F.count("*").alias("rows"), F.sum(F.xxhash64(*table.columns).cast("decimal(20,0)")).cast("string").alias("digest"))


def _exists(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system if system.exists(folder) else None


def save_model(fitted: FittedStack, path: str) -> None:
    """Write the model as a new version below ``path``; it counts only once its manifest, written last, is there.

    The manifest holds the settings and, for every table, its rows and a digest, both read back from what was written.
    """
    spark = fitted.vocab.table.sparkSession
    told = _versions(spark, path)
    folder = f"{path}/version={(told[-1] if told else 0) + 1:06d}-{uuid4().hex[:8]}"
    digests = {}
    for name, table in zip(_STORED, (fitted.vocab.table, fitted.labels, fitted.weights)):
        table.write.parquet(f"{folder}/{name}")
        back = spark.read.parquet(f"{folder}/{name}")
        digests[name] = back.agg(_digest(back).alias("d")).first()["d"].asDict()
    settings = {
        "stack": asdict(fitted.stack), "n_docs": fitted.vocab.n_docs, "size": fitted.vocab.size, "n_labels": fitted.n_labels, "n_slots": fitted.n_slots,
        "steps": fitted.steps, "gradient": fitted.gradient, "converged": fitted.converged, "tables": digests,
    }
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.text(f"{folder}/manifest")


def _folders(spark: SparkSession, path: str) -> list[str]:
    system = _exists(spark, path)
    if system is None:
        return []
    names = [s.getPath().getName() for s in system.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))]
    return sorted(n for n in names if n.startswith("version="))


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(name[8:14]) for name in _folders(spark, path)]


def load_model(spark: SparkSession, path: str) -> FittedStack:
    """The newest version whose manifest is there; a table that differs from its manifest raises.

    A version still being written, or left half-written, has no manifest and is passed over; if there is no other, the
    model is not there.
    """
    complete = [n for n in _folders(spark, path) if _exists(spark, f"{path}/{n}/manifest/_SUCCESS") is not None]
    if not complete:
        raise FileNotFoundError(f"no whole stored model under {path}")
    folder = f"{path}/{complete[-1]}"
    told = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    tables = {}
    for name, known in told["tables"].items():
        if _exists(spark, f"{folder}/{name}") is None:
            raise ValueError(f"the stored model under {folder} lacks its table {name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
        if tables[name].agg(_digest(tables[name]).alias("d")).first()["d"].asDict() != known:
            raise ValueError(f"the table {name} of the stored model under {folder} is not what was stored")
    vocab = X.TermVocabulary(tables["vocab"], told["n_docs"], told["size"])
    _ = vocab.lookup, vocab.slots  # sent to the workers now, so that scoring starts no job of its own
    ended = (told[k] for k in ("n_slots", "steps", "gradient", "converged"))
    return FittedStack(TextStack(**told["stack"]), vocab, tables["labels"], told["n_labels"], tables["weights"], *ended)


def predict_batch(
    df: DataFrame, path: str, id_column: str, text: str, model_type: str = STACK_NAME
) -> DataFrame:
    """Score a text table with a stored model."""
    if model_type in NEURAL_STACKS:
        raise ValueError(f"{model_type} needs its own network; store its scores and use functions.scores")
    if model_type != STACK_NAME:
        raise ValueError(f"unknown model type: {model_type}")
    return predict_proba(load_model(df.sparkSession, path), df, id_column, text)


def majority_baseline(train: DataFrame, rows: DataFrame, label: str = "category") -> DataFrame:
    """Predict the largest training class for every row; the alphabet breaks a tie."""
    sizes = train.groupBy(label).agg(F.count("*").alias("_n"))
    largest = sizes.orderBy(F.desc("_n"), label).limit(1).select(label).scalar()
    return rows.withColumn("y_pred", largest)
