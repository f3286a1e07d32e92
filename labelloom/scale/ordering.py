"""Exact positions and ranks without pulling a whole table, or a whole group, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.scale.staging import stage

_ROW_BITS = 33  # monotonically_increasing_id() keeps the row number of a partition in its low 33 bits


def ordered_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based position of every row under ``order``, which must be a total order.

    Range partitioning sorts in parallel; a row's position is its offset inside its partition plus the
    sizes of the partitions before it. The partition and offset are staged with the row, so the two
    passes agree even if tasks are rerun.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered").select(
        *df.columns,
        F.shiftright("_at", _ROW_BITS).alias("_part"),
        F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1).alias("_offset"),
    )
    # One row per partition: both this window and the broadcast are bounded by the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        staged.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return staged.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_offset")).alias(name)
    )


def top_rows(df: DataFrame, order: list[Column], n: int, inline: int = 5_000) -> DataFrame:
    """The first ``n`` rows under a total order; large ``n`` is ranked in parallel instead of in one task."""
    if n <= inline:
        return df.orderBy(*order).limit(n)
    return ordered_index(df, order, "_rank").filter(F.col("_rank") < n).drop("_rank")


def number_rows(df: DataFrame, order: list[Column], name: str, bound: int | None, inline: int = 200_000) -> DataFrame:
    """0-based position under a total order, for a table known to have at most ``bound`` rows (None: unknown)."""
    if bound is None or bound > inline:
        return ordered_index(df, order, name)
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def rank_in_group(
    df: DataFrame, group: str, size: str, spread_hex: str, tie: str, name: str, prefix: int = 4
) -> DataFrame:
    """0-based rank of a row inside ``group`` by (``size`` desc, ``spread_hex`` asc, ``tie`` asc).

    A group may hold a third of the table, so it is cut into cells by size and by the first ``prefix``
    characters of the hex digest. Ranks inside a cell come from a window over that cell alone; the
    number of rows in earlier cells comes from a table of cell counts.
    """
    cell = [group, size, "_prefix"]
    rows = df.withColumn("_prefix", F.substring(spread_hex, 1, prefix))
    before = (
        Window.partitionBy(group)
        .orderBy(F.desc(size), "_prefix")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        rows.groupBy(*cell)
        .agg(F.count("*").alias("_cell_rows"))
        .select(*cell, F.coalesce(F.sum("_cell_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*cell).orderBy(spread_hex, tie)
    return (
        rows.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, cell)
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_prefix", "_start", "_at")
    )
