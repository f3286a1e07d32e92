"""Row filters, derived columns, class filters and conflicting-label removal.

Every operator takes and returns a DataFrame. ``plans.slice`` composes them into the whole
preparation with as little data movement as possible.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.scale.joins import lookup_join, pin
from labelloom.scale.ordering import ordered_index
from labelloom.scale.staging import stage
from labelloom.schema import (
    CATEGORY_SEPARATOR,
    COMPLAINT_ID_PREFIX,
    FINAL_COLUMNS,
    MIN_CLASS_COUNT,
    MIN_TEXT_LENGTH,
    NARRATIVE,
    RECORD_ID,
    REQUIRED_COLUMNS,
)


def all_present(columns: list[str]) -> Column:
    """True where none of ``columns`` is null."""
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def has_required() -> Column:
    return all_present(REQUIRED_COLUMNS)


def longer_than(text: Column, limit: int) -> Column:
    """Stripped length above ``limit``; the plain length is tested first because it is cheap."""
    return (F.length(text) > limit) & T.stripped_longer_than(text, limit)


def category_of(product: Column, issue: Column) -> Column:
    return F.concat(product, F.lit(CATEGORY_SEPARATOR), issue)


def select_required(df: DataFrame) -> DataFrame:
    """Row key and the raw columns only, so that the scan reads nothing else."""
    return df.select(RECORD_ID, *REQUIRED_COLUMNS)


def drop_null_required(df: DataFrame) -> DataFrame:
    """Rows without a null. Written as IS NOT NULL tests, which reach the Parquet scan; ``dropna`` does not."""
    return df.filter(has_required())


def min_text_length(df: DataFrame, limit: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Keep texts strictly longer than ``limit`` once stripped; the stored text stays as it is."""
    return df.filter(longer_than(F.col(NARRATIVE), limit))


def non_empty_text(df: DataFrame, column: str = NARRATIVE) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & T.has_text(F.col(column)))


def fill_text(df: DataFrame, column: str = NARRATIVE) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))


def derive_category(df: DataFrame) -> DataFrame:
    return df.withColumn("category", category_of(F.col("product"), F.col("issue")))


def derive_text_key(df: DataFrame) -> DataFrame:
    return df.withColumn("text_key", T.text_key(F.col(NARRATIVE)))


def derive_digest(df: DataFrame) -> DataFrame:
    """SHA-256 of the text key. Duplicate and conflict logic groups by this and never shuffles the text."""
    return df.withColumn("key_digest", T.key_digest(F.col("text_key")))


def class_sizes(df: DataFrame, column: str = "category") -> DataFrame:
    """Rows per class. Partial aggregation leaves one row per class and task to shuffle."""
    return df.groupBy(column).agg(F.count("*").alias("class_rows"))


def min_class_count(df: DataFrame, minimum: int = MIN_CLASS_COUNT) -> DataFrame:
    """Rows whose class has at least ``minimum`` rows."""
    kept = pin(class_sizes(df).filter(F.col("class_rows") >= minimum), "classes")
    return lookup_join(df, kept, "category", "left_semi", "class_rows", F.col(RECORD_ID))


def key_groups(df: DataFrame, label: str = "category") -> DataFrame:
    """One row per text key: size, least and greatest label, and whether the two differ.

    A numeric label keeps the aggregation hash-based; text labels make Spark sort first.
    """
    return df.groupBy("key_digest").agg(
        F.count("*").alias("key_rows"), F.min(label).alias(label), F.max(label).alias(f"other_{label}")
    ).withColumn("conflicting", F.col(label) != F.col(f"other_{label}"))


def conflicting_keys(df: DataFrame) -> DataFrame:
    """Text keys mapped to more than one category, with the first and last of those categories."""
    return key_groups(df).filter("conflicting").select(
        "key_digest", "key_rows", F.col("category").alias("first_category"),
        F.col("other_category").alias("last_category"),
    )


def drop_conflicts(df: DataFrame) -> DataFrame:
    """Drop every row of a conflicting key; duplicates within one category stay."""
    conflicts = stage(conflicting_keys(df).select("key_digest", "key_rows"), "conflicts")
    return lookup_join(df, conflicts, "key_digest", "left_anti", "key_rows", F.col(RECORD_ID))


def class_refilter(df: DataFrame, minimum: int = MIN_CLASS_COUNT) -> DataFrame:
    """The class filter once more after conflict removal: a single pass, not a fixpoint."""
    return min_class_count(df, minimum)


def remaining_conflicts(df: DataFrame, label: str = "category") -> DataFrame:
    """How many conflicting keys are left."""
    return key_groups(df, label).agg(F.count_if("conflicting").alias("n_conflicting_text_keys_after"))


def assign_complaint_id(df: DataFrame) -> DataFrame:
    """Prefix plus 0-based position in source order."""
    numbered = ordered_index(df, [F.col(RECORD_ID)], "_position")
    return numbered.withColumn(
        "complaint_id", F.concat(F.lit(COMPLAINT_ID_PREFIX), F.col("_position").cast("string"))
    ).drop("_position")


def select_final(df: DataFrame) -> DataFrame:
    return df.select(*FINAL_COLUMNS)
