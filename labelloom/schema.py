"""Column names and default settings of the complaint data model."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Names and thresholds that files, reports and results must agree on.
NARRATIVE = "consumer_complaint_narrative"
REQUIRED_COLUMNS = ["consumer_complaint_narrative", "product", "issue"]
FINAL_COLUMNS = ["complaint_id", "consumer_complaint_narrative", "text_key", "product", "issue", "category"]
SPLITS = ["train", "val", "test"]
SEED = 42
MIN_TEXT_LENGTH = 20
MIN_CLASS_COUNT = 5
COMPLAINT_ID_PREFIX = "cfpb_"
CATEGORY_SEPARATOR = "|"
TASK = "category_only"
SPLIT_STRATEGY = "stratified_group_kfold_by_text_key"

# Unique, orderable row key that every input table carries besides the raw columns.
RECORD_ID = "record_id"


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise naming every absent column."""
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"required columns are missing: {absent}")
    return df
