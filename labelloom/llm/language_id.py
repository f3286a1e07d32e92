"""Language identification with interpolated Kneser-Ney character models, one per language.

A text is the bag of its words (runs of letters, lower case). A model gives each letter of a word, and its end, a
probability from up to ``ORDER - 1`` preceding characters of that word, its start included. Counts of the
longest contexts are raw, those of shorter ones count distinct left extensions; each order is discounted and
interpolated with the next lower, the lowest with the uniform distribution.

All languages share one sorted array of 64-bit n-gram hashes per order, with a column of discounted probabilities per
language, and one of context hashes with a column of interpolation weights. Since contexts stay inside words,
a word's log-probabilities are computed once per worker and then looked up.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.rows import whole_row
from labelloom.llm.shingles import mixed

ORDER = 5
FIT_DOCS = 600  # bound on the labelled documents per language that the models are fitted on
MAX_LANGUAGES = 2_000  # more distinct labels than this are an error, not something to cut
UNKNOWN = "und"
_CALIBRATE = 5  # every fifth document of the sample calibrates the rejection instead of the counts
_CHUNK = 400
_MAX_CACHED = 100_000  # words a worker remembers; a task that meets more begins anew
_NEW_WORDS = 2_000  # words scored at a time: each holds some tables of (letters x languages)
_SURE_CHARS, _EVEN_CHARS = 40, 400
_START, _END = "\x02", "\x03"
_LETTERS = re.compile(r"[^\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def letter_words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(words: Counter) -> Counter:
    """Count of every longest n-gram: a character with its up to ORDER - 1 predecessors."""
    counts: Counter = Counter()
    for word, n in words.items():
        whole = _START + word + _END
        for end in range(2, len(whole) + 1):
            counts[whole[max(0, end - ORDER) : end]] += n
    return counts


class LanguageModels:
    """Sorted hash arrays of all languages. ``grams``: per language the count of every longest n-gram."""

    def __init__(self, grams: dict[str, dict[str, int]]) -> None:
        self.languages = sorted(grams)
        probability: list[dict[str, np.ndarray]] = [defaultdict(self._zeros) for _ in range(ORDER)]
        carry: list[dict[str, np.ndarray]] = [defaultdict(self._ones) for _ in range(ORDER)]
        self.uniform = np.ones(len(self.languages))
        for column, language in enumerate(self.languages):
            for order, counts in enumerate(_levels(grams[language])):
                ones = sum(1 for n in counts.values() if n == 1)
                twos = sum(1 for n in counts.values() if n == 2)
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                total: Counter = Counter()
                kinds: Counter = Counter()
                for gram, n in counts.items():
                    total[gram[:-1]] += n
                    kinds[gram[:-1]] += 1
                for gram, n in counts.items():
                    probability[order][gram][column] = (n - discount) / total[gram[:-1]]
                for context, n in total.items():
                    carry[order][context][column] = discount * kinds[context] / n
                if order == 0:
                    self.uniform[column] = 1.0 / (len(counts) + 1)
        self.grams = [_packed(level) for level in probability]
        self.contexts = [_packed(level) for level in carry]

    def _zeros(self) -> np.ndarray:
        return np.zeros(len(self.languages))

    def _ones(self) -> np.ndarray:
        return np.ones(len(self.languages))

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """One row per word, one column per language."""
        joined = "".join(_START + w + _END for w in words)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        lengths = np.array([len(w) + 2 for w in words])
        starts = np.cumsum(lengths) - lengths
        offset = np.arange(len(codes)) - np.repeat(starts, lengths)
        p = np.broadcast_to(self.uniform, (len(codes), len(self.languages))).copy()
        context = np.zeros(len(codes), dtype=np.uint64)
        for order in range(ORDER):
            where = np.flatnonzero(offset >= max(order, 1))
            if not len(where):
                break
            gram = np.zeros(len(codes), dtype=np.uint64)
            gram[order:] = _hash_step(codes, order)
            weight, _ = _looked_up(self.contexts[order], mixed(context[where - 1] if order else context[where]), 1.0)
            seen, _ = _looked_up(self.grams[order], mixed(gram[where]), 0.0)
            p[where] = seen + weight * p[where]
            context = gram
        logs = np.log(p)
        logs[starts] = 0.0
        return np.add.reduceat(logs, starts, axis=0)


def _hash_step(codes: np.ndarray, order: int) -> np.ndarray:
    """Polynomial hash of the ``order + 1`` codes that end at each position from ``order`` on."""
    n = len(codes) - order
    total = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(order + 1):
        total = total * _STEP + codes[i : i + n] + np.uint64(1)
    return total


def _packed(level: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of equally long strings, and their values."""
    if not level:
        return np.empty(0, dtype=np.uint64), np.empty((0, 0))
    width = len(next(iter(level)))
    codes = np.frombuffer("".join(level).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    table = codes.reshape(len(level), width)
    total = np.zeros(len(level), dtype=np.uint64)
    for i in range(width):
        total = total * _STEP + table[:, i] + np.uint64(1)
    hashes = mixed(total)
    order = np.argsort(hashes)
    return hashes[order], np.array(list(level.values()))[order]


def _looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    hashes, values = table
    if not len(hashes):
        return np.full((len(keys), 1), missing), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    hit = hashes[at] == keys
    found = values[at]
    found[~hit] = missing
    return found, hit


def _levels(longest: dict[str, int]) -> list[dict[str, int]]:
    """Counts per order, lowest first: raw where the context reaches the word's start or is longest, else left extensions."""
    levels: list[Counter] = [Counter() for _ in range(ORDER)]
    for gram, n in longest.items():
        levels[len(gram) - 1][gram] += n
    for order in range(ORDER - 1, 0, -1):
        for gram in levels[order]:
            levels[order - 1][gram[1:]] += 1
    return levels


class Scorer:
    """Mean negative log-probability per character of texts, for every language."""

    def __init__(self, models: LanguageModels) -> None:
        self.models, self.index = models, {}
        self.rows = np.empty((1024, len(models.languages)), dtype=np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per language, characters counted) of every text; a text without words has 0 characters."""
        words = [letter_words(t) for t in texts]
        new = list({w for own in words for w in own if w not in self.index})
        if len(self.index) + len(new) > _MAX_CACHED:
            self.index, new = {}, list({w for own in words for w in own})
        for low in range(0, len(new), _NEW_WORDS):
            part = new[low : low + _NEW_WORDS]
            need = len(self.index) + len(part)
            if need > len(self.rows):
                grown = np.empty((2 * need, self.rows.shape[1]), dtype=np.float32)
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            self.rows[len(self.index) : need] = self.models.log_probabilities(part)
            self.index.update(zip(part, range(len(self.index), need)))
        sums = np.zeros((len(texts), self.rows.shape[1]))
        chars = np.zeros(len(texts))
        for i, own in enumerate(words):
            if own:
                sums[i] = self.rows[list(map(self.index.__getitem__, own))].sum(axis=0, dtype=np.float64)
                chars[i] = sum(map(len, own)) + len(own)
        return -sums / np.maximum(chars, 1)[:, None], chars


class Identifier:
    """Models with their calibration: the mean cross-entropy of each language, and how far from it a text may be.

    A text is rejected when two things hold. Its cross-entropy is nearer to that of the calibration texts with every
    word spelled backwards (the same letters, not the language) than to that of the texts themselves. And its
    excess over the mean, times the square root of its (bounded) length, is larger than one and a half times the largest
    among the calibration texts, plus one, so that a few odd letters do not decide.
    """

    def __init__(self, models: LanguageModels, calibration: list[tuple[str, str]]) -> None:
        self.models = models
        count = len(models.languages)
        self.mean, self.limit, self.half = np.zeros(count), np.full(count, np.inf), np.full(count, np.inf)
        scorer = Scorer(models)
        ce, chars = scorer.entropies([t for _, t in calibration])
        backward, _ = scorer.entropies([" ".join(w[::-1] for w in letter_words(t)) for _, t in calibration])
        for column, language in enumerate(models.languages):
            own = np.array([lang == language for lang, _ in calibration], dtype=bool) & (chars > 0)
            if own.any():
                even = np.minimum(chars[own], _EVEN_CHARS)
                self.mean[column] = np.average(ce[own, column], weights=even)
                self.half[column] = (self.mean[column] + np.average(backward[own, column], weights=even)) / 2
                self.limit[column] = 1.5 * max(self._distance(ce[own, column], chars[own], column).max(), 0.0) + 1.0

    def _distance(self, ce: np.ndarray, chars: np.ndarray, column) -> np.ndarray:
        return (ce - self.mean[column]) * np.sqrt(np.minimum(chars, _EVEN_CHARS))

    def predict(self, scorer: Scorer, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of every text."""
        if not self.models.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        ce, chars = scorer.entropies(texts)
        best = ce.argmin(axis=1)
        lead = (ce - ce.min(axis=1)[:, None]) * np.minimum(chars, _SURE_CHARS)[:, None]
        score = 1.0 / np.exp(-lead).sum(axis=1)
        lowest = ce[np.arange(len(texts)), best]
        rejected = (lowest > self.half[best]) & (self._distance(lowest, chars, best) > self.limit[best])
        names = [self.models.languages[i] for i in best]
        for i, text in enumerate(texts):
            if not has_letter(text):
                names[i], score[i], rejected[i] = UNKNOWN, 0.0, True
        return names, score, rejected


def in_training(id_col: str) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, mod 4, is not 2. A null id is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words[lang].update(letter_words(text))
    for lang, own in words.items():
        counts = gram_counts(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "gram", "n"],
        )


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS
) -> Identifier:
    """Fit on at most ``fit_docs`` whole documents per language, chosen by hashes of their ids.

    The choice reads ids and labels only. What reaches the driver, n-gram counts and calibration texts, is bounded by
    the sample, whatever the size of the table.
    """
    labelled = docs.filter(in_training(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    # Thin every language to about twice the bound by the hash of the id before ranking, so that no language meets
    # in one task with more rows than that.
    named = labelled.select("id", "lang")
    sizes = named.groupBy("lang").agg(F.count("*").alias("size")).limit(MAX_LANGUAGES + 1)
    if sizes.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chance = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40)) * F.col("size").cast("double") < F.lit(2 * fit_docs) * F.lit(float(1 << 40))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = (
        named.join(F.broadcast(sizes), "lang")
        .filter(chance)
        .withColumn("turn", F.row_number().over(order))
        .filter(F.col("turn") <= fit_docs)
    )
    listed = chosen.select("id", "turn").toPandas()
    if not len(listed):
        return Identifier(LanguageModels({}), [])
    spark = docs.sparkSession
    ids = spark.createDataFrame(listed.drop_duplicates("id"), f"id {dict(named.dtypes)['id']}, turn int")
    texts = labelled.join(F.broadcast(ids), "id").select("lang", "text", "turn")
    to_count = texts.filter(F.col("turn") % _CALIBRATE != 0).select("lang", "text")
    counted = to_count.mapInArrow(_counted, "lang string, gram string, n long")
    grams: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, gram, n in counted.groupBy("lang", "gram").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False):
        grams[lang][gram] = n
    held = texts.filter(F.col("turn") % _CALIBRATE == 0).select("lang", "text").collect()
    known = [(r["lang"], r["text"]) for r in held if r["lang"] in grams]
    return Identifier(LanguageModels(grams), known)


def identify_languages(
    docs: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (default: the id) of every row with lang_pred, score and rejected, from its whole text alone.

    ``lang_pred`` is the language of the lowest cross-entropy per character, ties to the first code; ``und`` with score 0 and rejected if
    the text is null or has no letter, or if nothing was learned. ``score`` is the share of the best language in the likelihood
    of a text of at most 40 characters. Repeated rows repeat; rows are independent, so there is no shuffle.
    """
    keep = keep or [id_col]
    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(identifier.models)
        for batch in batches:
            for low in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(low, _CHUNK)
                names, score, rejected = identifier.predict(scorer, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                    names=[*keep, "lang_pred", "score", "rejected"],
                )

    told = T.StructType.fromDDL("lang_pred string, score double, rejected boolean")
    schema = T.StructType([*[docs.schema[c] for c in keep], *told.fields])
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    return chosen.mapInArrow(identified, schema)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns and values as they were."""
    identifier = fit_languages(docs, id_col, text_col, lang_col)
    own = [c.lower() for c in docs.columns].index(text_col.lower())
    if docs.dtypes[own][1] != "string":
        told = identify_languages(docs.select(F.col(text_col).alias("text"), whole_row(docs)), identifier, text_col="text", keep=["row"])
        return told.filter(~F.col("rejected")).select("row.*")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole rows in, those not rejected out: a text leaves the JVM once, inside its row."""
        scorer = Scorer(identifier.models)
        for batch in batches:
            for low in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(low, _CHUNK)
                _, _, rejected = identifier.predict(scorer, part.column(0).field(own).to_pylist())
                yield part.filter(pa.array(~rejected))

    rows = docs.select(whole_row(docs))
    return rows.mapInArrow(kept, rows.schema).select("row.*")
