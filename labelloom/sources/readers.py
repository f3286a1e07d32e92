"""Scans of raw complaint files and prepared splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators.prepare import all_present
from labelloom.schema import NARRATIVE, RECORD_ID, REQUIRED_COLUMNS, SPLITS, require_columns
from labelloom.sources.csv_records import read_csv_records

# Markers that a raw CSV file uses for a missing value besides the empty field.
CSV_MISSING = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _csv(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return reader.csv(path)


def _missing_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.when(~F.col(c).isin("", *CSV_MISSING), F.col(c)).alias(c) if kind == "string" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def read_complaints(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Raw complaints with a unique ``record_id`` in source order; raises when a required column is absent.

    Parquet tables bring their own ``record_id``. CSV rows are strings with quoted line breaks; every split of a
    file is a task (see :mod:`labelloom.sources.csv_records`), and rows are numbered in the order of paths and lines.
    """
    if file_format == "parquet":
        return require_columns(spark.read.parquet(path), [RECORD_ID, *REQUIRED_COLUMNS])
    if file_format != "csv":
        raise ValueError("file_format must be 'parquet' or 'csv'")
    names = require_columns(_csv(spark, path), REQUIRED_COLUMNS).columns
    return _missing_to_null(read_csv_records(spark, path, names, RECORD_ID))


def read_split(
    spark: SparkSession,
    path: str,
    split: str,
    text: str = NARRATIVE,
    label: str = "category",
    file_format: str = "parquet",
) -> DataFrame:
    """One split of the prepared table without rows lacking text or label; other splits are not read."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    table = spark.read.parquet(path) if file_format == "parquet" else _missing_to_null(_csv(spark, path))
    part = require_columns(table, ["split", text, label]).filter(F.col("split") == split)
    return drop_unlabelled(part, text, label)


def drop_unlabelled(df: DataFrame, text: str = NARRATIVE, label: str = "category") -> DataFrame:
    return df.filter(all_present([text, label]))


def strip_and_drop_empty(df: DataFrame, text: str = NARRATIVE, label: str = "category") -> DataFrame:
    """Strip text and label of Unicode whitespace and drop rows in which either is missing or empty."""
    stripped = drop_unlabelled(df, text, label).withColumns(
        {text: T.strip(F.col(text)), label: T.strip(F.col(label))}
    )
    return stripped.filter((F.col(text) != "") & (F.col(label) != ""))


def read_split_strict(spark: SparkSession, path: str, split: str, text: str = NARRATIVE, label: str = "category",
                      file_format: str = "parquet") -> DataFrame:
    """:func:`read_split` with text and label stripped and empties dropped."""
    return strip_and_drop_empty(read_split(spark, path, split, text, label, file_format), text, label)
