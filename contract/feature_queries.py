"""Term statistics, TF-IDF, token vocabularies, encoding, labels and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import sql as Q
from contract.registry import query
from contract.tables import complaints, shared, split_of, splits, terms_of, tokens_of, train_rows
from labelloom.operators import features as X
from labelloom.schema import RECORD_ID

MAX_FEATURES = 50_000  # the default of the stack


def _vocab(spark, sf_dir) -> X.TermVocabulary:
    train = train_rows(spark, sf_dir)
    stats = X.term_stats(terms_of(train))
    return X.fit_vocabulary(stats, train.count(), min_df=2, max_df=0.95, max_features=MAX_FEATURES)


@query(Q.with_(f"""
doc_terms AS (SELECT doc_id, {Q.words(Q.tfidf_clean('text'), 2)} AS terms FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(terms) AS term FROM doc_terms) GROUP BY ALL)""",
"SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM tf GROUP BY term"))
def term_stats(spark, sf_dir):
    return X.term_stats(terms_of(complaints(spark, sf_dir), (1, 1)))


@query(Q.with_(Q.vocab_ctes(MAX_FEATURES), "SELECT term, term_id, df, cf FROM vocab"))
def select_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir).table.drop("idf")


@query(Q.with_(Q.vocab_ctes(None), "SELECT term, term_id, df, cf FROM vocab"))
def select_vocab_uncapped(spark, sf_dir):
    train = train_rows(spark, sf_dir)
    stats = X.term_stats(terms_of(train))
    return X.select_vocab(stats, train.count(), max_features=None).drop("idf")


@query(Q.with_(Q.vocab_ctes(MAX_FEATURES), "SELECT term, round(idf, 6) AS idf FROM vocab"))
def idf(spark, sf_dir):
    return _vocab(spark, sf_dir).table.select("term", F.round("idf", 6).alias("idf"))


@query(Q.with_(Q.vocab_ctes(MAX_FEATURES), """
SELECT record_id, term_id, round(weight, 6) AS weight FROM weights WHERE split = 'train'"""))
def tfidf_weights(spark, sf_dir):
    rows = X.tfidf_rows(terms_of(train_rows(spark, sf_dir)), _vocab(spark, sf_dir), RECORD_ID)
    return rows.withColumn("weight", F.round("weight", 6))


_PER_DOC = """
SELECT p.record_id, count(w.term_id) AS n_terms, round(coalesce(sum(w.weight), 0e0), 6) AS weight_sum,
       round(coalesce(sum(w.weight * w.term_id / (SELECT count(*) FROM vocab)), 0e0), 6) AS weighted_ids
FROM prepared p LEFT JOIN weights w USING (record_id) WHERE p.split <> 'train' GROUP BY p.record_id"""


def _per_doc(arrays, size):
    def total(column):
        return F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x)

    products = F.zip_with("indices", "weights", lambda i, w: i * w / size)
    return arrays.select(
        RECORD_ID,
        F.size("indices").alias("n_terms"),
        F.round(total(F.col("weights")), 6).alias("weight_sum"),
        F.round(total(products), 6).alias("weighted_ids"),
    )


@query(Q.with_(Q.vocab_ctes(MAX_FEATURES), _PER_DOC))
def tfidf_transform(spark, sf_dir):
    held_out = terms_of(split_of(spark, sf_dir, "val", "test"))
    vocab = _vocab(spark, sf_dir)
    return _per_doc(X.tfidf_transform(held_out, vocab, RECORD_ID), vocab.size)


@query(Q.with_(Q.vocab_ctes(MAX_FEATURES), _PER_DOC))
def tfidf_transform_by_join(spark, sf_dir):
    held_out = terms_of(split_of(spark, sf_dir, "val", "test"))
    vocab = _vocab(spark, sf_dir)
    return _per_doc(X.tfidf_by_join(held_out, vocab, RECORD_ID, max_broadcast_rows=0), vocab.size)


@query(Q.with_(Q.vocab_ctes(MAX_FEATURES), """
SELECT p.record_id, count(w.term_id) AS n_nonzero, round(coalesce(sum(w.weight * w.weight), 0e0), 6) AS squared_norm
FROM prepared p LEFT JOIN weights w USING (record_id) GROUP BY p.record_id"""))
def to_vectors(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    arrays = X.tfidf_transform(terms_of(splits(spark, sf_dir)), vocab, RECORD_ID)
    parts = X.to_vectors(arrays, vocab.size).select(RECORD_ID, F.unwrap_udt("features").alias("v"))
    squared = F.aggregate("v.values", F.lit(0.0), lambda acc, x: acc + x * x)
    return parts.select(
        RECORD_ID, F.size("v.indices").alias("n_nonzero"), F.round(squared, 6).alias("squared_norm")
    )


# --- sequences ------------------------------------------------------------------

MAX_LENGTH = 384


def _tokens_and_vocab(spark, sf_dir):
    tokens = tokens_of(splits(spark, sf_dir), "split")
    return tokens, X.build_vocab(tokens.filter(F.col("split") == "train"))


@query(Q.with_(Q.token_ctes(), "SELECT token, token_id, freq FROM token_vocab"))
def build_vocab(spark, sf_dir):
    return _tokens_and_vocab(spark, sf_dir)[1]


_ENCODED = Q.token_ctes() + f""",
placed AS (
  SELECT record_id, unnest(tokens[1:{MAX_LENGTH}]) AS token, generate_subscripts(tokens[1:{MAX_LENGTH}], 1) AS at
  FROM doc_tokens
),
ids AS (
  SELECT p.record_id, list(coalesce(v.token_id, 1) ORDER BY p.at) AS ids
  FROM placed p LEFT JOIN token_vocab v USING (token) GROUP BY p.record_id
)"""


@query(Q.with_(_ENCODED, f"""
SELECT record_id, array_to_string(
  list_concat(ids, list_transform(range({MAX_LENGTH} - len(ids)), lambda i: 0)), ' ') AS input_ids FROM ids"""))
def encode(spark, sf_dir):
    tokens, vocab = _tokens_and_vocab(spark, sf_dir)
    encoded = X.encode(tokens, vocab, MAX_LENGTH)
    return encoded.select(RECORD_ID, F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


@query(Q.with_(_ENCODED, f"""
SELECT record_id, array_to_string(
  list_concat(ids, list_transform(range({MAX_LENGTH} - len(ids)), lambda i: 0)), ' ') AS input_ids FROM ids"""))
def encode_by_join(spark, sf_dir):
    tokens, vocab = _tokens_and_vocab(spark, sf_dir)
    encoded = X.encode(tokens, vocab, MAX_LENGTH, max_broadcast_rows=0)
    return encoded.select(RECORD_ID, F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


@query(Q.with_(Q.token_ctes(), f"""
SELECT record_id, array_to_string(list_transform(
  range({MAX_LENGTH}), lambda i: CASE WHEN i < least(len(tokens), {MAX_LENGTH}) THEN 1 ELSE 0 END), '') AS mask
FROM doc_tokens"""))
def attention_mask(spark, sf_dir):
    tokens, vocab = _tokens_and_vocab(spark, sf_dir)
    encoded = X.encode(tokens, vocab, MAX_LENGTH)
    return encoded.select(RECORD_ID, F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("mask"))


@query(Q.with_(Q.token_ctes(), """
SELECT split, count(*) AS total_tokens, count(v.token_id) AS covered_tokens,
       count(*) - count(v.token_id) AS unk_tokens,
       CAST(count(*) - count(v.token_id) AS DOUBLE) / count(*) AS oov_rate
FROM (SELECT split, unnest(tokens) AS token FROM doc_tokens) t LEFT JOIN token_vocab v USING (token)
GROUP BY split"""))
def oov_stats(spark, sf_dir):
    tokens = tokens_of(splits(spark, sf_dir), "split")
    vocab = X.build_vocab(tokens.filter(F.col("split") == "train"))
    return X.oov_stats(tokens, vocab)


# --- labels and weights -----------------------------------------------------------


@query(Q.with_(Q.LABELS, "SELECT category, label_id FROM labels_by_id"))
def label_index(spark, sf_dir):
    return shared(spark, sf_dir).labels


@query(Q.with_(Q.LABELS, "SELECT record_id, label_id FROM prepared JOIN labels_by_id USING (category)"))
def encode_labels(spark, sf_dir):
    return X.encode_labels(splits(spark, sf_dir), shared(spark, sf_dir).labels).select(RECORD_ID, "label_id")


@query(Q.with_(Q.LABELS, "SELECT record_id, category FROM prepared JOIN labels_by_id USING (category)"))
def decode_labels(spark, sf_dir):
    labels = shared(spark, sf_dir).labels
    ids = X.encode_labels(splits(spark, sf_dir), labels).select(RECORD_ID, "label_id")
    return X.decode_labels(ids, labels).select(RECORD_ID, "category")


@query(Q.with_(Q.PREPARED + """,
sizes AS (SELECT category, count(*) AS class_rows FROM prepared WHERE split = 'train' GROUP BY category)""", """
SELECT category, class_rows, CAST((SELECT sum(class_rows) FROM sizes) AS DOUBLE)
  / ((SELECT count(*) FROM sizes) * class_rows) AS weight FROM sizes"""))
def balanced_class_weights(spark, sf_dir):
    return X.balanced_class_weights(train_rows(spark, sf_dir))


@query(Q.with_(Q.LABELS + """,
sizes AS (SELECT category, count(*) AS n FROM prepared WHERE split = 'val' GROUP BY category),
floored AS (
  SELECT l.category, l.label_id, greatest(coalesce(n, 0), 1) AS n FROM labels_by_id l LEFT JOIN sizes USING (category)
),
balanced AS (
  SELECT category, label_id, CAST((SELECT sum(n) FROM floored) AS DOUBLE) / ((SELECT count(*) FROM floored) * n) AS w
  FROM floored
)""", """
SELECT category, label_id, round(least(w / (SELECT avg(w) FROM balanced), 1.1e0), 6) AS weight FROM balanced"""))
def clipped_class_weights(spark, sf_dir):
    held_out = split_of(spark, sf_dir, "val")
    weights = X.clipped_class_weights(held_out, shared(spark, sf_dir).labels, max_weight=1.1)
    return weights.withColumn("weight", F.round("weight", 6))
