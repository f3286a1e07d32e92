"""Sinks for splits, encoded sequences, vocabularies, metadata and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.features import PAD_TOKEN, UNK_TOKEN
from labelloom.operators.split import split_profile
from labelloom.schema import FINAL_COLUMNS, MIN_TEXT_LENGTH, NARRATIVE, SEED, SPLIT_STRATEGY, SPLITS, TASK


def write_splits(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "overwrite") -> None:
    """The prepared table, one folder per split."""
    writer = df.select(*FINAL_COLUMNS, *[c for c in df.columns if c not in FINAL_COLUMNS]).write.mode(mode)
    writer = writer.partitionBy("split")
    if file_format == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("file_format must be 'parquet' or 'csv'")


def split_metadata(
    df: DataFrame, stats: DataFrame | None = None, seed: int = SEED, min_text_length: int = MIN_TEXT_LENGTH
) -> DataFrame:
    """One row: seed, task, the settings used, rows and classes per split, columns, and the preparation counts."""
    profile = split_profile(df)

    def of(split: str, column: str):
        return F.coalesce(F.max(F.when(F.col("split") == split, F.col(column))), F.lit(0)).cast("long")

    row = profile.agg(
        F.lit(seed).alias("seed"),
        F.lit(TASK).alias("task"),
        F.lit(min_text_length).alias("min_text_len"),
        F.lit(SPLIT_STRATEGY).alias("split_strategy"),
        *[of(s, "n_rows").alias(f"{s}_rows") for s in SPLITS],
        F.array(*[F.lit(c) for c in FINAL_COLUMNS]).alias("columns"),
        F.struct(*[of(s, "n_classes").alias(s) for s in SPLITS]).alias("n_categories_by_split"),
    )
    if stats is None:
        return row
    # Both sides are single rows.
    return row.join(stats.select(F.struct(*stats.columns).alias("prepare_stats")))


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.coalesce(1).write.mode("overwrite").json(path)


def write_encoded(df: DataFrame, path: str) -> None:
    """Token ids, mask and label ids, one folder per split."""
    df.select("split", "input_ids", "attention_mask", F.col("label_id").alias("labels")).write.mode(
        "overwrite"
    ).partitionBy("split").parquet(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def encode_metadata(
    vocab: DataFrame,
    labels: DataFrame,
    max_length: int,
    max_vocab_size: int,
    min_token_freq: int,
    text: str = NARRATIVE,
    label: str = "category",
) -> DataFrame:
    """One row describing encoded splits: settings, real vocabulary size and labels in id order."""
    named = labels.agg(
        F.count("*").alias("n_labels"),
        F.transform(F.sort_array(F.collect_list(F.struct("label_id", F.col(label).alias("name")))), lambda r: r["name"])
        .alias("labels"),
    )
    size = vocab.agg(F.count("*")).scalar()
    return named.select(
        F.lit(text).alias("text_column"),
        F.lit(label).alias("label_column"),
        F.lit(max_length).alias("max_length"),
        F.lit(max_vocab_size).alias("max_vocab_size"),
        F.lit(min_token_freq).alias("min_token_freq"),
        size.alias("actual_vocab_size"),
        F.lit(PAD_TOKEN).alias("pad_token"),
        F.lit(UNK_TOKEN).alias("unk_token"),
        "n_labels",
        "labels",
    )


def write_report(df: DataFrame, path: str, file_format: str = "csv") -> None:
    """A report table as CSV with a header, or as JSON lines, in one file; the work above it stays parallel."""
    writer = df.repartition(1).write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif file_format == "json":
        writer.json(path)
    else:
        raise ValueError("file_format must be 'csv' or 'json'")
