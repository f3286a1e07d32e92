"""Row filters, class and conflict rules, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import sql as Q
from contract.registry import query
from contract.tables import complaints, gappy_complaints, shared, splits
from labelloom.functions import text as T
from labelloom.operators import prepare as P
from labelloom.operators import split as S
from labelloom.scale.ordering import ordered_index
from labelloom.schema import NARRATIVE, RECORD_ID

_GAPPY = """
gappy AS (
  SELECT d.doc_id AS record_id, CASE WHEN l.quality IS NOT NULL THEN d.text END AS narrative, d.lang AS product,
         CASE WHEN coalesce(l.toxic, 0) <> 1 THEN d.source END AS issue
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


@query("SELECT doc_id AS record_id, text AS consumer_complaint_narrative, lang AS product, source AS issue FROM documents")
def select_required(spark, sf_dir):
    return P.select_required(complaints(spark, sf_dir))


@query(Q.with_(_GAPPY, """
SELECT record_id, product, issue FROM gappy
WHERE narrative IS NOT NULL AND product IS NOT NULL AND issue IS NOT NULL"""))
def drop_null_required(spark, sf_dir):
    return P.drop_null_required(gappy_complaints(spark, sf_dir)).select(RECORD_ID, "product", "issue")


@query(f"SELECT doc_id AS record_id, length(text) AS n_chars FROM documents WHERE length({Q.strip('text')}) > 20")
def min_text_length(spark, sf_dir):
    return P.min_text_length(complaints(spark, sf_dir)).select(RECORD_ID, F.length(NARRATIVE).alias("n_chars"))


@query("SELECT doc_id AS record_id, lang || '|' || source AS category FROM documents")
def derive_category(spark, sf_dir):
    return P.derive_category(complaints(spark, sf_dir)).select(RECORD_ID, "category")


@query(f"SELECT doc_id AS record_id, {Q.text_key('text')} AS text_key, sha256({Q.text_key('text')}) AS key_digest FROM documents")
def derive_text_key(spark, sf_dir):
    keyed = P.derive_digest(P.derive_text_key(complaints(spark, sf_dir)))
    return keyed.select(RECORD_ID, "text_key", "key_digest")


@query(Q.with_(_GAPPY, f"""
SELECT record_id, product FROM gappy WHERE narrative IS NOT NULL AND {Q.strip('narrative')} <> ''"""))
def non_empty_text(spark, sf_dir):
    return P.non_empty_text(gappy_complaints(spark, sf_dir)).select(RECORD_ID, "product")


@query(Q.with_(_GAPPY, "SELECT record_id, length(coalesce(narrative, '')) AS n_chars FROM gappy"))
def fill_text(spark, sf_dir):
    return P.fill_text(gappy_complaints(spark, sf_dir)).select(RECORD_ID, F.length(NARRATIVE).alias("n_chars"))


def _base(spark, sf_dir):
    kept = P.min_text_length(P.drop_null_required(complaints(spark, sf_dir)))
    return P.derive_digest(P.derive_text_key(P.derive_category(kept)))


@query(Q.with_(Q.CHAIN, "SELECT record_id, category FROM in_class"))
def min_class_count(spark, sf_dir):
    return P.min_class_count(P.derive_category(complaints(spark, sf_dir)).transform(P.min_text_length)).select(
        RECORD_ID, "category"
    )


@query(Q.with_(Q.CHAIN, "SELECT sha256(text_key) AS key_digest, key_rows, first_category, last_category FROM conflicts"))
def conflicting_keys(spark, sf_dir):
    return P.conflicting_keys(P.min_class_count(_base(spark, sf_dir)))


@query(Q.with_(Q.CHAIN, "SELECT record_id, category FROM clean"))
def drop_conflicts(spark, sf_dir):
    return P.drop_conflicts(P.min_class_count(_base(spark, sf_dir))).select(RECORD_ID, "category")


@query(Q.with_(Q.CHAIN, "SELECT record_id, category FROM refiltered"))
def class_refilter(spark, sf_dir):
    cleaned = P.drop_conflicts(P.min_class_count(_base(spark, sf_dir)))
    return P.class_refilter(cleaned).select(RECORD_ID, "category")


@query(Q.with_(Q.CHAIN, """
SELECT count(*) AS n_conflicting_text_keys_after
FROM (SELECT text_key FROM refiltered GROUP BY text_key HAVING count(DISTINCT category) > 1)"""))
def remaining_conflicts(spark, sf_dir):
    return P.remaining_conflicts(P.derive_digest(splits(spark, sf_dir)))


@query(Q.with_(Q.CHAIN, """
SELECT (SELECT count(*) FROM documents) AS rows_raw,
  (SELECT count(*) FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL) AS rows_after_na,
  (SELECT count(*) FROM base) AS rows_after_min_len,
  (SELECT count(*) FROM in_class) AS rows_after_class_filter,
  (SELECT count(*) FROM in_class) AS rows_before_conflict_filter,
  (SELECT count(*) FROM clean) AS rows_after_conflict_filter,
  (SELECT count(*) FROM in_class) - (SELECT count(*) FROM clean) AS dropped_conflict_rows,
  (SELECT count(*) FROM refiltered) AS rows_after_class_refilter,
  (SELECT count(*) FROM refiltered) AS rows_after_text_key,
  CAST(0 AS BIGINT) AS dropped_by_text_dedup,
  (SELECT count(DISTINCT category) FROM base) AS n_classes_before_min_count,
  (SELECT count(DISTINCT category) FROM in_class) AS n_classes_after_min_count,
  (SELECT coalesce(min(n), 0) FROM (SELECT count(*) AS n FROM in_class GROUP BY category)) AS min_class_size_after_filter,
  (SELECT count(DISTINCT category) FROM refiltered) AS n_classes_after_refilter,
  (SELECT coalesce(min(n), 0) FROM (SELECT count(*) AS n FROM refiltered GROUP BY category)) AS min_class_size_after_refilter,
  (SELECT count(*) FROM conflicts) AS n_conflicting_text_keys_before,
  (SELECT count(*) FROM (SELECT text_key FROM refiltered GROUP BY text_key HAVING count(DISTINCT category) > 1))
    AS n_conflicting_text_keys_after,
  CAST(5 AS BIGINT) AS min_class_count_threshold"""))
def prepare_funnel(spark, sf_dir):
    return shared(spark, sf_dir).slice.funnel()


@query(Q.with_(Q.PREPARED, """
SELECT complaint_id, text AS consumer_complaint_narrative, text_key, product, issue, category FROM prepared"""))
def prepare(spark, sf_dir):
    return shared(spark, sf_dir).slice.rows()


@query(Q.with_(Q.PREPARED, "SELECT record_id, complaint_id FROM prepared"))
def assign_complaint_id(spark, sf_dir):
    return shared(spark, sf_dir).slice.numbered.select(RECORD_ID, "complaint_id")


@query(Q.with_(Q.PREPARED, """
SELECT category, split, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM prepared GROUP BY category, split"""))
def prepared_by_category_and_split(spark, sf_dir):
    return splits(spark, sf_dir).groupBy("category", "split").agg(
        F.count("*").alias("n_rows"), F.sum(F.length(NARRATIVE)).alias("n_chars")
    )


# --- splits ---------------------------------------------------------------------


@query(Q.with_(Q.GROUPED, "SELECT key_digest, category, key_rows, fold FROM folds"))
def group_stratified_folds(spark, sf_dir):
    return S.group_stratified_folds(shared(spark, sf_dir).slice.groups)


@query(Q.with_(Q.PREPARED, "SELECT record_id, split FROM prepared"))
def train_val_test_split(spark, sf_dir):
    prepared = shared(spark, sf_dir).slice
    prepared.check()
    return prepared.records.select(RECORD_ID, "split")


@query(Q.with_(Q.CHAIN, """
SELECT record_id,
  CASE WHEN CAST('0x' || substr(md5('42|o|' || sha256(text_key)), 1, 8) AS BIGINT) % 5 = 0 THEN 'test'
       WHEN CAST('0x' || substr(md5('42|i|' || sha256(text_key)), 1, 8) AS BIGINT) % 5 = 0 THEN 'val'
       ELSE 'train' END AS split
FROM refiltered"""))
def hash_group_split(spark, sf_dir):
    return S.hash_group_split(shared(spark, sf_dir).slice.records).select(RECORD_ID, "split")


@query(Q.with_(Q.PREPARED, """
SELECT record_id, split, row_number() OVER (
  ORDER BY md5('42|' || CAST(record_id AS VARCHAR)), record_id) - 1 AS position
FROM prepared"""))
def shuffle(spark, sf_dir):
    mixed = S.shuffle(splits(spark, sf_dir).select(RECORD_ID, "split"), RECORD_ID)
    return ordered_index(mixed, [F.col("shuffle_key"), F.col(RECORD_ID)], "position").drop("shuffle_key")


@query(Q.with_(Q.PREPARED, """
SELECT split, count(*) AS n_rows, count(DISTINCT category) AS n_classes FROM prepared GROUP BY split"""))
def split_profile(spark, sf_dir):
    return S.split_profile(splits(spark, sf_dir))


_ROW_SPLIT = """
row_split AS (
  SELECT *, CASE WHEN h % 5 = 0 THEN 'test' WHEN h % 5 = 1 THEN 'val' ELSE 'train' END AS row_split FROM (
    SELECT *, CAST('0x' || substr(md5('row|' || CAST(record_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM base)
),
keys AS (SELECT DISTINCT text_key, row_split FROM row_split)"""


def _split_by_row(spark, sf_dir):
    """A split that ignores duplicate texts, so that there is leakage to find."""
    token = F.md5(F.concat(F.lit("row|"), F.col(RECORD_ID).cast("string")))
    h = F.pmod(F.conv(F.substring(token, 1, 8), 16, 10).cast("long"), F.lit(5))
    return _base(spark, sf_dir).withColumn("split", F.when(h == 0, "test").when(h == 1, "val").otherwise("train"))


def _overlap(a: str, b: str) -> str:
    return (
        f"(SELECT count(*) FROM (SELECT text_key FROM keys WHERE row_split = '{a}' INTERSECT "
        f"SELECT text_key FROM keys WHERE row_split = '{b}'))"
    )


@query(Q.with_(Q.BASE + "," + _ROW_SPLIT, f"""
SELECT {_overlap('train', 'val')} AS train_val, {_overlap('train', 'test')} AS train_test,
       {_overlap('val', 'test')} AS val_test"""))
def split_leakage(spark, sf_dir):
    return S.split_leakage(_split_by_row(spark, sf_dir))


@query(Q.with_(Q.PREPARED + ", keys AS (SELECT DISTINCT text_key, split AS row_split FROM prepared)", f"""
SELECT {_overlap('train', 'val')} AS train_val, {_overlap('train', 'test')} AS train_test,
       {_overlap('val', 'test')} AS val_test"""))
def split_leakage_of_group_split(spark, sf_dir):
    return S.split_leakage(splits(spark, sf_dir))


@query(Q.with_(Q.BASE + "," + _ROW_SPLIT + """,
small_train AS (
  SELECT category, CASE row_split WHEN 'val' THEN 'train' WHEN 'test' THEN 'val' ELSE 'test' END AS split
  FROM row_split
)""", """
SELECT split, category, count(*) AS n_rows FROM small_train
WHERE split <> 'train' AND category NOT IN (SELECT category FROM small_train WHERE split = 'train')
GROUP BY ALL"""))
def unseen_labels(spark, sf_dir):
    split = F.col("split")
    renamed = F.when(split == "val", "train").when(split == "test", "val").otherwise("test")
    return S.unseen_labels(_split_by_row(spark, sf_dir).withColumn("split", renamed))
