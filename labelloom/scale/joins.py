"""Joins of a large, possibly very skewed table with a table that has one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.scale.staging import stage

# Class-level tables up to this size are kept as local relations; larger ones are staged.
MAX_PINNED_ROWS = 20_000
# A table is only broadcast after its rows were counted and found to be at most this many.
MAX_BROADCAST_ROWS = 200_000
# A key is hot when it holds at least this many rows of the large side, and is cut into pieces of about that size.
HOT_KEY_ROWS = 1_000_000
# Hot keys are listed largest first; by pigeonhole a key outside the list holds < 1/MAX_HOT_KEYS of the rows.
MAX_HOT_KEYS = 100_000


def pin(table: DataFrame, label: str, max_rows: int = MAX_PINNED_ROWS) -> DataFrame:
    """Compute a class-level table once, as a staged table; a small one is then kept as a local relation."""
    staged = stage(table, label)
    if staged.count() > max_rows:
        return staged
    return table.sparkSession.createDataFrame(staged.toArrow(), table.schema)


def fits_broadcast(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Count at most ``max_rows + 1`` rows. Cheap on staged tables, which answer from Parquet footers."""
    return table.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str,
    how: str = "inner",
    weight: str | None = None,
    spread: Column | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    hot_key_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Join ``rows`` to ``table`` (unique on ``on``): broadcast if it is small, else shuffle without hot spots.

    ``weight`` names a column of ``table`` holding how many rows share the key; with it the shuffle
    variant salts the keys known to be hot. ``spread`` is any well-distributed value of a row.
    """
    if fits_broadcast(table, max_broadcast_rows):
        return rows.join(F.broadcast(table), on, how)
    if weight is None or spread is None:
        return rows.join(table, on, how)
    return salted_join(rows, table, on, how, weight, spread, hot_key_rows)


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    on: str,
    how: str,
    weight: str,
    spread: Column,
    hot_key_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Shuffle join in which a hot key is cut into about ``weight / hot_key_rows`` pieces; other keys are left alone."""
    hot = (
        table.filter(F.col(weight) >= hot_key_rows)
        .orderBy(F.desc(weight), on)
        .limit(MAX_HOT_KEYS)
        .select(on, (F.ceil(F.col(weight) / hot_key_rows) + 1).cast("int").alias("_pieces"))
    )
    pieces = F.coalesce("_pieces", F.lit(1))
    salted_rows = (
        rows.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), pieces).cast("int"))
        .drop("_pieces")
    )
    salted_table = (
        table.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("_pieces")
    )
    return salted_rows.join(salted_table, [on, "_salt"], how).drop("_salt")
