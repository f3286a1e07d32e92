"""Round trips through the readers and writers."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from contract import sql as Q
from contract.evaluate_queries import tail_class_metrics
from contract.feature_queries import MAX_LENGTH, _ENCODED
from contract.model_queries import fitted
from contract.registry import query
from contract.tables import complaints, pairs, shared, splits, tokens_of
from labelloom.operators import evaluate as E
from labelloom.operators import features as X
from labelloom.operators import model as M
from labelloom.scale.staging import shared_dir
from labelloom.schema import NARRATIVE, RECORD_ID
from labelloom.sources import readers as R
from labelloom.sources import writers as W


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid4().hex}"


@query("""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS record_id, lang AS product, source AS issue,
       length(text) AS n_chars, md5(text) AS text_md5 FROM documents""")
def read_complaints_csv(spark, sf_dir):
    """Documents written as quoted CSV in id order, read back and numbered in file order."""
    path = _folder(spark, "csv")
    ordered = complaints(spark, sf_dir).repartitionByRange(RECORD_ID).sortWithinPartitions(RECORD_ID)
    ordered.drop(RECORD_ID).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    read = R.read_complaints(spark, path, "csv")
    return read.select(
        RECORD_ID, "product", "issue", F.length(NARRATIVE).alias("n_chars"), F.md5(NARRATIVE).alias("text_md5")
    )


@query("SELECT doc_id AS record_id, lang AS product, source AS issue, length(text) AS n_chars FROM documents")
def read_complaints_parquet(spark, sf_dir):
    path = _folder(spark, "raw")
    complaints(spark, sf_dir).write.parquet(path)
    read = R.read_complaints(spark, path)
    return read.select(RECORD_ID, "product", "issue", F.length(NARRATIVE).alias("n_chars"))


def _written(spark, sf_dir) -> str:
    path = _folder(spark, "splits")
    W.write_splits(splits(spark, sf_dir), path)
    return path


@query(Q.with_(Q.PREPARED, "SELECT record_id, complaint_id, category FROM prepared WHERE split = 'val'"))
def read_split(spark, sf_dir):
    return R.read_split(spark, _written(spark, sf_dir), "val").select(RECORD_ID, "complaint_id", "category")


@query(Q.with_(Q.PREPARED, f"""
SELECT record_id, length({Q.strip("'  ' || text || chr(160)")}) AS n_chars, category FROM prepared
WHERE split = 'test' AND {Q.strip('text')} <> ''"""))
def read_split_strict(spark, sf_dir):
    """The test split with padding added to every text, which the strict reader strips."""
    path = _folder(spark, "splits")
    padded = splits(spark, sf_dir).withColumn(NARRATIVE, F.concat(F.lit("  "), NARRATIVE, F.lit(" ")))
    W.write_splits(padded, path)
    read = R.read_split_strict(spark, path, "test")
    return read.select(RECORD_ID, F.length(NARRATIVE).alias("n_chars"), "category")


@query(Q.with_(Q.PREPARED, """
SELECT complaint_id, text AS consumer_complaint_narrative, text_key, product, issue, category, split FROM prepared"""))
def write_splits(spark, sf_dir):
    return spark.read.parquet(_written(spark, sf_dir)).drop(RECORD_ID, "key_digest")


@query(Q.with_(Q.PREPARED, """
SELECT CAST(42 AS BIGINT) AS seed, 'stratified_group_kfold_by_text_key' AS split_strategy,
  count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows,
  count(*) FILTER (split = 'test') AS test_rows,
  count(DISTINCT category) FILTER (split = 'train') AS train_classes,
  count(DISTINCT category) FILTER (split = 'val') AS val_classes,
  count(DISTINCT category) FILTER (split = 'test') AS test_classes,
  (SELECT count(*) FROM documents) AS rows_raw, count(*) AS rows_after_text_key
FROM prepared"""))
def write_metadata(spark, sf_dir):
    prepared = shared(spark, sf_dir).slice
    path = _folder(spark, "metadata")
    W.write_metadata(W.split_metadata(prepared.numbered, prepared.funnel()), path)
    return spark.read.json(path).select(
        "seed",
        "split_strategy",
        "train_rows",
        "val_rows",
        "test_rows",
        *[F.col(f"n_categories_by_split.{s}").alias(f"{s}_classes") for s in ("train", "val", "test")],
        "prepare_stats.rows_raw",
        "prepare_stats.rows_after_text_key",
    )


@query(Q.with_(_ENCODED + """,
labels_by_id AS (
  SELECT category, row_number() OVER (ORDER BY category) - 1 AS label_id
  FROM (SELECT DISTINCT category FROM prepared WHERE split = 'train')
)""", f"""
SELECT p.split, l.label_id AS labels, md5(array_to_string(
  list_concat(ids, list_transform(range({MAX_LENGTH} - len(ids)), lambda i: 0)), ' ')) AS ids_md5, len(ids) AS n_real
FROM ids JOIN prepared p USING (record_id) JOIN labels_by_id l USING (category)"""))
def write_encoded(spark, sf_dir):
    path = _folder(spark, "encoded")
    tokens = tokens_of(splits(spark, sf_dir), "split", "category")
    vocab = X.build_vocab(tokens.filter(F.col("split") == "train"))
    encoded = X.encode_labels(X.encode(tokens, vocab, MAX_LENGTH), shared(spark, sf_dir).labels)
    W.write_encoded(encoded, path)
    return spark.read.parquet(path).select(
        "split",
        "labels",
        F.md5(F.array_join(F.col("input_ids").cast("array<string>"), " ")).alias("ids_md5"),
        F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x).alias("n_real"),
    )


@query(Q.with_(Q.token_ctes(), "SELECT token, token_id, freq FROM token_vocab"))
def write_vocab(spark, sf_dir):
    path = _folder(spark, "vocab")
    tokens = tokens_of(splits(spark, sf_dir), "split")
    W.write_vocab(X.build_vocab(tokens.filter(F.col("split") == "train")), path)
    return spark.read.parquet(path)


@query(Q.with_(Q.token_ctes(), """
SELECT CAST(384 AS BIGINT) AS max_length, CAST(50000 AS BIGINT) AS max_vocab_size, CAST(2 AS BIGINT) AS min_token_freq,
  (SELECT count(*) FROM token_vocab) AS actual_vocab_size, '<pad>' AS pad_token, '<unk>' AS unk_token,
  count(DISTINCT category) AS n_labels, (SELECT string_agg(category, '/' ORDER BY category) FROM (
    SELECT DISTINCT category FROM prepared WHERE split = 'train')) AS labels
FROM prepared WHERE split = 'train'"""))
def write_encode_metadata(spark, sf_dir):
    path = _folder(spark, "metadata")
    tokens = tokens_of(splits(spark, sf_dir), "split")
    vocab = X.build_vocab(tokens.filter(F.col("split") == "train"))
    W.write_metadata(W.encode_metadata(vocab, shared(spark, sf_dir).labels, MAX_LENGTH, 50_000, 2), path)
    return (
        spark.read.json(path)
        .withColumn("labels", F.array_join("labels", "/"))
        .drop("text_column", "label_column")
    )


@query(Q.with_(Q.TAIL, "SELECT category, support_test, f1, fn_count, fp_count FROM tail_metrics"))
def write_report_csv(spark, sf_dir):
    path = _folder(spark, "report")
    W.write_report(tail_class_metrics(spark, sf_dir), path)
    read = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return read.select(
        "category",
        F.col("support_test").cast("bigint"),
        F.col("f1").cast("double"),
        F.col("fn_count").cast("bigint"),
        F.col("fp_count").cast("bigint"),
    )


@query(Q.with_(Q.METRICS, "SELECT category, tp, support, f1 FROM metrics"))
def write_report_json(spark, sf_dir):
    path = _folder(spark, "report")
    W.write_report(E.prf_support(E.class_counts(pairs(spark, sf_dir))), path, "json")
    return spark.read.json(path).select("category", "tp", "support", "f1")


@query(Q.with_(Q.PREPARED, "SELECT count(*) AS n_rows, 0 AS n_changed FROM prepared"))
def save_and_load_model(spark, sf_dir):
    """Rows whose label differs between a model and its stored copy; expected 0."""
    path = _folder(spark, "model")
    model = fitted(spark, sf_dir)
    M.save_model(model, path)
    rows = splits(spark, sf_dir)
    before = M.predict(model, rows, RECORD_ID, NARRATIVE)
    after = M.predict(M.load_model(spark, path), rows, RECORD_ID, NARRATIVE)
    both = before.join(after.withColumnRenamed("y_pred", "again"), RECORD_ID)
    return both.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("y_pred") != F.col("again")).alias("n_changed")
    )
