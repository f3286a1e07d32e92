"""Whole rows as one value, so that no column of a table can clash with a name used by an operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")
