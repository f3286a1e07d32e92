"""Term statistics, TF-IDF features, token vocabularies, sequence encoding and class weights."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from labelloom.functions import text as T
from labelloom.scale.joins import MAX_BROADCAST_ROWS, fits_broadcast, lookup_join, pin
from labelloom.scale.ordering import number_rows, top_rows
from labelloom.scale.staging import stage

# Special tokens, their ids and the limits on vocabulary settings.
PAD_TOKEN, UNK_TOKEN = "<pad>", "<unk>"
PAD_ID, UNK_ID = 0, 1
MIN_VOCAB_SIZE, MIN_TOKEN_FREQ, MIN_SEQUENCE = 10, 1, 8
ANALYZERS = ("word", "char_wb")


class EmptyVocabulary(ValueError):
    """No term meets the frequency limits."""


def analyze(text: Column, analyzer: str = "word", ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """All terms of a text, repeats included."""
    if analyzer == "word":
        return T.word_ngrams(T.word_tokens(text), *ngram_range)
    if analyzer == "char_wb":
        return T.char_wb_ngrams(text, *ngram_range)
    raise ValueError(f"analyzer must be one of {ANALYZERS}, got {analyzer!r}")


# --- TF-IDF -----------------------------------------------------------------


# Bytes of a term in the sorted hash table (hash, id, idf), and the largest such table that is sent to the workers.
LOOKUP_ROW_BYTES, MAX_LOOKUP_BYTES = 20, 128 << 20
SIEVE_WORDS = 1 << 17  # 64-bit words of the bitmap that sifts terms before a join
WEIGHED_TERMS = 500_000  # terms vectorised at a time; one document may have more


@dataclass(frozen=True)
class TermVocabulary:
    """``table`` has one row per kept term: term, term_id, df, cf, idf."""

    table: DataFrame
    n_docs: int
    size: int

    @cached_property
    def lookup(self) -> Broadcast | None:
        """Sorted 64-bit hashes of the terms with their ids and idf, sent to the workers once; None if too large for that.

        Workers look whole batches up by binary search. Two terms with one hash give None as well, so the table is exact for its own
        terms; a foreign term is taken for one of them with a chance of ``size / 2**64``.
        """
        if self.size * LOOKUP_ROW_BYTES > MAX_LOOKUP_BYTES:
            return None
        rows = self.table.select(F.xxhash64("term").alias("hash"), "term_id", "idf").toArrow()
        hashes = rows["hash"].to_numpy()
        order = np.argsort(hashes)
        hashes = hashes[order]
        if (hashes[1:] == hashes[:-1]).any():
            return None
        found = hashes, rows["term_id"].to_numpy()[order].astype(np.int32), rows["idf"].to_numpy()[order]
        return self.table.sparkSession.sparkContext.broadcast(found)

    @cached_property
    def slots(self) -> Broadcast | None:
        """Per term id the ``slot`` of the linear model it shares and its ``share`` of it; None if every term has its own."""
        if "slot" not in self.table.columns:
            return None
        rows = self.table.orderBy("term_id").select("slot", "share").toArrow()
        found = rows["slot"].to_numpy().astype(np.int64), rows["share"].to_numpy()
        return self.table.sparkSession.sparkContext.broadcast(found)


def shared_slots(vocab: TermVocabulary) -> tuple[TermVocabulary, int]:
    """A vocabulary whose terms with equal marks (see :func:`term_stats`) share a slot, and the number of slots.

    Columns of a training matrix that no row tells apart are one column for a linear model with a squared penalty: m equal
    columns with a coefficient each are fitted as one column sqrt(m) times as long, of whose coefficient each gets 1 / sqrt(m).
    That is exact, not a selection: every term keeps its coefficient. The table is bounded as :attr:`TermVocabulary.lookup` is;
    a larger one, and one without marks, is left as it is.
    """
    keys = [c for c in ("mark_high", "mark_low", "df", "cf", "cuts") if c in vocab.table.columns]
    if "mark_high" not in keys or vocab.size * LOOKUP_ROW_BYTES > MAX_LOOKUP_BYTES:
        return vocab, vocab.size
    first = vocab.table.groupBy(*keys).agg(F.min("term_id").alias("_first"), F.count("*").alias("_held"))
    numbered = number_rows(first, [F.col("_first")], "slot", vocab.size)
    joined = vocab.table.join(numbered, keys).withColumn("share", 1.0 / F.sqrt("_held")).drop("_first", "_held")
    table = stage(joined.withColumn("slot", F.col("slot").cast("int")), "slots")
    return TermVocabulary(table, vocab.n_docs, vocab.size), table.select("slot").distinct().count()


def term_stats(docs: DataFrame, terms: str = "terms", id_column: str | None = None) -> DataFrame:
    """Document and corpus frequency of every term.

    The one shuffle is on the term, after partial sums; a term found in every document costs one row per task. Each row gives its
    distinct terms and all its terms, told apart by a number, so nothing is sorted inside a row. With ``id_column`` (unique per row) a term also gets
    ``mark_high`` and ``mark_low``, sums over its rows of the halves of a hash of (id, tf): terms with equal marks stand in the
    same rows, equally often in each.
    """
    if id_column is None:
        both = T.bind(F.col(terms), lambda own: F.array(F.array_distinct(own), own))
        listed = docs.select(F.posexplode(both).alias("_all", "_terms")).select("_all", F.explode("_terms").alias("term"))
        return listed.groupBy("term").agg(F.count_if(F.col("_all") == 0).alias("df"), F.count_if(F.col("_all") == 1).alias("cf"))
    counted = docs.select(F.col(id_column).alias("_id"), F.inline(T.term_counts(F.col(terms))))
    counted = counted.select("term", "tf", F.xxhash64("_id", "tf").alias("_mark"))
    marks = [
        F.sum(F.shiftrightunsigned("_mark", 32)).alias("mark_high"),
        F.sum(F.col("_mark").bitwiseAND(0xFFFFFFFF)).alias("mark_low"),
    ]
    return counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), *marks)


def _doc_limit(value: int | float, n_docs: int) -> float:
    return value if isinstance(value, int) else value * n_docs


def idf(n_docs: int, df: Column) -> Column:
    """Smoothed inverse document frequency plus one."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + 1.0


def select_vocab(
    stats: DataFrame,
    n_docs: int,
    min_df: int | float = 2,
    max_df: int | float = 0.95,
    max_features: int | None = 50_000,
) -> DataFrame:
    """Terms within the document-frequency limits; of those the ``max_features`` most frequent.

    Integers are counts, floats are shares of the documents. Ties at the cut go to the term that sorts
    first; ids follow the alphabet.
    """
    low, high = _doc_limit(min_df, n_docs), _doc_limit(max_df, n_docs)
    if high < low:
        raise EmptyVocabulary("max_df corresponds to fewer documents than min_df")
    kept = stats.filter((F.col("df") >= low) & (F.col("df") <= high))
    if max_features is not None:
        kept = top_rows(kept, [F.desc("cf"), F.col("term")], max_features)
    more = [c for c in stats.columns if c.startswith("mark_")]
    return numbered_terms(kept, max_features).select("term", "term_id", "df", "cf", idf(n_docs, F.col("df")).alias("idf"), *more)


def numbered_terms(terms: DataFrame, bound: int | None) -> DataFrame:
    """Add ``term_id``, which follows the alphabet; ``bound`` is the largest number of terms there can be, if known."""
    return number_rows(terms, [F.col("term")], "term_id", bound).withColumn("term_id", F.col("term_id").cast("int"))


def empty_reason(stats: DataFrame, n_docs: int, min_df: int | float, max_df: int | float) -> str | None:
    """Why a vocabulary with these limits would be empty; None if it would not."""
    low, high = _doc_limit(min_df, n_docs), _doc_limit(max_df, n_docs)
    if high < low:
        return "max_df corresponds to fewer documents than min_df"
    if stats.filter((F.col("df") >= low) & (F.col("df") <= high)).isEmpty():
        return "no terms remain; lower min_df or raise max_df"
    return None


def fit_vocabulary(stats: DataFrame, n_docs: int, **limits) -> TermVocabulary:
    table = stage(select_vocab(stats, n_docs, **limits), "terms")
    size = table.count()
    if size == 0:
        raise EmptyVocabulary("no terms remain; lower min_df or raise max_df")
    return TermVocabulary(table, n_docs, size)


def _sublinear(tf: Column, idf_value: Column) -> Column:
    return (1.0 + F.log(tf)) * idf_value


def _sieve_word(term: str) -> Column:
    """The word of the bitmap that holds a term's bit."""
    return F.pmod(F.xxhash64(term), F.lit(SIEVE_WORDS)).cast("int")


def _sieve_bit(term: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{term}`), 58) as int))")


def tfidf_by_join(
    docs: DataFrame, vocab: TermVocabulary, id_column: str, terms: str = "terms", **join_limits
) -> DataFrame:
    """TF-IDF arrays for a vocabulary of any size: join on the term, then one group per document.

    Most terms of a text are foreign to a vocabulary, so they are sifted by a bitmap of fixed size before they are shuffled; the few
    that pass it vanish in the join. Documents left without terms come back with empty arrays.
    """
    counted = docs.select(id_column, F.inline(T.term_counts(F.col(terms))))
    table = vocab.table.select("term", "term_id", "idf", "df")
    sieve = stage(table.groupBy(_sieve_word("term").alias("_word")).agg(F.bit_or(_sieve_bit("term")).alias("_bits")), "sieve")
    passed = (_sieve_word("term") == F.col("_word")) & (_sieve_bit("term").bitwiseAND(F.col("_bits")) != 0)
    counted = counted.join(F.broadcast(sieve), passed, "left_semi")  # at most SIEVE_WORDS rows, whatever the vocabulary
    known = lookup_join(counted, table, "term", "inner", "df", F.col(id_column), **join_limits)
    weighted = known.select(
        id_column, F.struct("term_id", _sublinear(F.col("tf"), F.col("idf")).alias("raw")).alias("entry")
    )
    grouped = weighted.groupBy(id_column).agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    entries = F.coalesce(F.col("entries"), F.array().cast("array<struct<term_id:int,raw:double>>"))
    return (
        docs.drop(terms)
        .join(grouped, id_column, "left")
        .withColumn("entries", entries)
        .withColumn("indices", F.col("entries.term_id"))
        .withColumn("weights", _unit_length(F.col("entries.raw")))
        .drop("entries")
    )


def _unit_length(raw: Column) -> Column:
    """Divide an array by its Euclidean norm."""

    def scaled(values: Column) -> Column:
        norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
        return T.bind(norm, lambda n: F.transform(values, lambda x: x / n))

    return T.bind(raw, scaled)


def _weigher(lookup: Broadcast):
    """Arrow function from lists of term hashes to (indices, weights): counted, weighted and scaled a batch at a time."""

    @F.arrow_udf("struct<indices:array<int>,weights:array<double>>")
    def weigh(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        # A batch of long texts is weighed by slices, so that what is held beside it does not grow with its terms.
        cuts = [0]
        while cuts[-1] < len(lists):
            before = ends[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, before + WEIGHED_TERMS, side="right"))))
        return pa.concat_arrays([weighed(lists.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])] or [weighed(lists)])

    def weighed(lists: pa.Array) -> pa.Array:
        hashes, ids, idfs = lookup.value
        rows = len(lists)
        lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if len(flat) == 0 or len(hashes) == 0:
            entry = np.empty(0, np.int64)
        else:
            at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
            known = hashes[at] == flat
            # One number for (row, term id), sorted: its runs are the terms of a row with their counts.
            entry = np.sort(np.repeat(np.arange(rows), lengths)[known] * np.int64(len(hashes)) + ids[at[known]])
        first = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1]))) if len(entry) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(entry)))
        row, index = np.divmod(entry[first], max(len(hashes), 1))
        idf_of = np.empty(len(hashes))
        idf_of[ids] = idfs
        raw = (1.0 + np.log(count)) * idf_of[index]
        norm = np.sqrt(np.bincount(row, weights=raw * raw, minlength=rows))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=rows))), pa.int32())
        columns = [pa.array(index.astype(np.int32)), pa.array(raw / norm[row])]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, c) for c in columns], ["indices", "weights"])

    return weigh


def tfidf_transform(docs: DataFrame, vocab: TermVocabulary, id_column: str, terms: str = "terms") -> DataFrame:
    """Replace ``terms`` by ``indices`` and ``weights``: sublinear tf x idf at unit length.

    Where the vocabulary's hash table may be sent out (:attr:`TermVocabulary.lookup`), terms leave the JVM as 64-bit hashes
    and documents are vectorised where they are, with no shuffle; else :func:`tfidf_by_join` does the same by join.
    """
    lookup = vocab.lookup
    if lookup is None:
        return tfidf_by_join(docs, vocab, id_column, terms)
    hashes = F.transform(F.col(terms), lambda t: F.xxhash64(t))
    kept = [c for c in docs.columns if c != terms]
    weighed = docs.select(*kept, _weigher(lookup)(hashes).alias("_entries"))
    return weighed.select(*kept, "_entries.indices", "_entries.weights")


def tfidf_rows(docs: DataFrame, vocab: TermVocabulary, id_column: str, terms: str = "terms") -> DataFrame:
    """Long form of :func:`tfidf_transform`: one row per document and known term."""
    arrays = tfidf_transform(docs, vocab, id_column, terms)
    return arrays.select(id_column, F.inline(F.arrays_zip("indices", "weights"))).select(
        id_column, F.col("indices").alias("term_id"), F.col("weights").alias("weight")
    )


def to_vectors(arrays: DataFrame, size: int) -> DataFrame:
    """Turn ``indices`` and ``weights`` into a sparse ``features`` vector column, for users of Spark ML.

    A vector column is stored as a plain struct, so the struct is staged and read back as vectors; that keeps the
    conversion in the JVM. The library's own fit and scoring need no vector column.
    """
    kept = [c for c in arrays.columns if c not in ("indices", "weights")]
    struct = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.col("indices"),
        F.col("weights").alias("values"),
    )
    stored = arrays.select(*kept, struct.alias("features"))
    fields = [f for f in stored.schema.fields if f.name != "features"]
    return stage(stored, "vectors", StructType([*fields, StructField("features", VectorUDT())]))


# --- token vocabulary and sequences ------------------------------------------


def token_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    return docs.select(F.explode(T.items(F.col(tokens))).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def build_vocab(
    docs: DataFrame, max_size: int = 50_000, min_freq: int = 2, tokens: str = "tokens"
) -> DataFrame:
    """Tokens by frequency (ties by token) with ids from 2; pad and unknown take ids 0 and 1.

    Special tokens found in the text do not compete for a place.
    """
    if max_size < MIN_VOCAB_SIZE:
        raise ValueError(f"max_size must be at least {MIN_VOCAB_SIZE}")
    if min_freq < MIN_TOKEN_FREQ:
        raise ValueError(f"min_freq must be at least {MIN_TOKEN_FREQ}")
    frequent = token_counts(docs, tokens).filter(
        (F.col("freq") >= min_freq) & ~F.col("token").isin(PAD_TOKEN, UNK_TOKEN)
    )
    order = [F.desc("freq"), F.col("token")]
    ranked = number_rows(top_rows(frequent, order, max_size - 2), order, "_rank", max_size).withColumn(
        "token_id", (F.col("_rank") + UNK_ID + 1).cast("int")
    )
    specials = docs.sparkSession.createDataFrame(
        [(PAD_TOKEN, PAD_ID, 0), (UNK_TOKEN, UNK_ID, 0)], "token string, token_id int, freq bigint"
    )
    return stage(specials.unionByName(ranked.select("token", "token_id", "freq")), "vocab")


def encode(
    docs: DataFrame,
    vocab: DataFrame,
    max_length: int = 256,
    min_length: int = MIN_SEQUENCE,
    id_column: str = "record_id",
    tokens: str = "tokens",
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Replace ``tokens`` by ``input_ids`` (first ``max_length`` tokens, right-padded) and ``attention_mask``.

    A null or empty token list gives a row of padding, a null token inside a list the unknown id.
    """
    if max_length < min_length:
        raise ValueError(f"max_length must be at least {min_length}")
    first = docs.withColumn(tokens, F.slice(tokens, 1, max_length))
    if fits_broadcast(vocab, max_broadcast_rows):
        # xxhash64 of null is its seed, so null tokens are kept null.
        hashes = F.transform(F.col(tokens), lambda t: F.when(t.isNotNull(), F.xxhash64(t)))
        ids = first.withColumn("_ids", _id_lookup(vocab)(hashes))
    else:
        ids = _ids_by_join(first, vocab, id_column, tokens)
    padding = F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - F.size("_ids"))
    return (
        ids.withColumn("input_ids", F.concat("_ids", padding))
        .withColumn("attention_mask", attention_mask(F.col("input_ids")))
        .drop(tokens, "_ids")
    )


def _id_lookup(vocab: DataFrame):
    """Arrow function mapping token lists to id lists through a sorted hash table that every worker gets once."""
    rows = vocab.select(F.xxhash64("token").alias("hash"), "token_id").toArrow()
    hashes = rows["hash"].to_numpy()
    order = np.argsort(hashes)
    hashes, ids = hashes[order], rows["token_id"].to_numpy()[order].astype(np.int32)
    if (hashes[1:] == hashes[:-1]).any():
        raise ValueError("two tokens of the vocabulary have one hash")
    shared = vocab.sparkSession.sparkContext.broadcast((hashes, ids))

    @F.arrow_udf("array<int>")
    def lookup(lists: pa.Array) -> pa.Array:
        known, number = shared.value
        # A null token has a null hash; it is the unknown id, as is a token outside the table.
        flat = lists.flatten()
        wanted = flat.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        hit = (known[at] == wanted) & flat.is_valid().to_numpy(zero_copy_only=False)
        found = np.where(hit, number[at], UNK_ID).astype(np.int32)
        # A null list has no values, so it becomes an empty one and is padded in full.
        ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(found))

    return lookup


def _ids_by_join(docs: DataFrame, vocab: DataFrame, id_column: str, tokens: str) -> DataFrame:
    placed = docs.select(id_column, F.posexplode(F.transform(F.col(tokens), lambda t: t)).alias("_at", "token"))
    known = lookup_join(placed, vocab, "token", "left", "freq", F.col(id_column), max_broadcast_rows=0)
    entry = F.struct("_at", F.coalesce("token_id", F.lit(UNK_ID)).alias("id"))
    grouped = known.groupBy(id_column).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    joined = docs.join(grouped, id_column, "left")
    ids = F.coalesce(F.col("_entries.id"), F.array().cast("array<int>"))
    return joined.withColumn("_ids", ids).drop("_entries")


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: (i != PAD_ID).cast("tinyint"))


def oov_stats(docs: DataFrame, vocab: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Total, covered and unknown tokens per split; tokens are counted before the vocabulary is joined."""
    counts = (
        docs.select("split", F.explode(T.items(F.col(tokens))).alias("token"))
        .groupBy("split", "token")
        .agg(F.count("*").alias("_n"))
    )
    known = vocab.select("token", "token_id")
    marked = lookup_join(counts, known, "token", "left")
    return (
        docs.select("split")
        .distinct()
        .join(
            marked.groupBy("split").agg(
                F.sum("_n").alias("total"), F.sum(F.when(F.col("token_id").isNotNull(), F.col("_n"))).alias("hit")
            ),
            "split",
            "left",
        )
        .select(
            "split",
            F.coalesce("total", F.lit(0)).alias("total_tokens"),
            F.coalesce("hit", F.lit(0)).alias("covered_tokens"),
            (F.coalesce("total", F.lit(0)) - F.coalesce("hit", F.lit(0))).alias("unk_tokens"),
            F.coalesce(F.try_divide(F.col("total") - F.coalesce("hit", F.lit(0)), F.col("total")), F.lit(0.0)).alias(
                "oov_rate"
            ),
        )
    )


# --- labels and weights --------------------------------------------------------


def label_index(df: DataFrame, label: str = "category") -> DataFrame:
    """Distinct labels in alphabetical order with ids from 0. Labels are as few as model outputs."""
    labels = df.select(label).distinct()
    numbered = labels.select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("label_id"))
    return pin(numbered, "labels")


def encode_labels(df: DataFrame, labels: DataFrame, label: str = "category", on_unseen: str = "raise") -> DataFrame:
    """Add ``label_id``; a label outside the table raises when the rows are computed, or stays null."""
    joined = lookup_join(df, labels, label, "left")
    if on_unseen != "raise":
        return joined
    problem = F.raise_error(F.concat(F.lit("label without an id: "), F.col(label))).cast("int")
    return joined.withColumn("label_id", F.coalesce("label_id", problem))


def decode_labels(df: DataFrame, labels: DataFrame, id_column: str = "label_id", label: str = "category") -> DataFrame:
    """Add the label of each id; an unknown id raises when the rows are computed."""
    table = labels.select(F.col("label_id").alias(id_column), label)
    joined = lookup_join(df, table, id_column, "left")
    problem = F.raise_error(F.concat(F.lit("id without a label: "), F.col(id_column).cast("string"))).cast("string")
    return joined.withColumn(label, F.coalesce(label, problem))


def balanced_class_weights(df: DataFrame, label: str = "category") -> DataFrame:
    """Rows / (classes x rows of the class)."""
    sizes = pin(df.groupBy(label).agg(F.count("*").alias("class_rows")), "classes")
    total = sizes.agg(F.sum("class_rows")).scalar()
    classes = sizes.agg(F.count("*")).scalar()
    return sizes.select(label, "class_rows", (total / (classes * F.col("class_rows"))).alias("weight"))


def clipped_class_weights(
    df: DataFrame, labels: DataFrame, max_weight: float = 3.0, label: str = "category"
) -> DataFrame:
    """Balanced weights with counts floored at 1, scaled to mean 1 and capped."""
    sizes = df.groupBy(label).agg(F.count("*").alias("class_rows"))
    counts = pin(
        labels.join(sizes, label, "left").select(
            label, "label_id", F.greatest(F.coalesce("class_rows", F.lit(0)), F.lit(1)).alias("n")
        ),
        "classes",
    )
    total, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count("*")).scalar()
    balanced = counts.withColumn("balanced", total / (classes * F.col("n")))
    mean = balanced.agg(F.avg("balanced")).scalar()
    return balanced.select(
        label, "label_id", F.least(F.col("balanced") / mean, F.lit(float(max_weight))).alias("weight")
    )
