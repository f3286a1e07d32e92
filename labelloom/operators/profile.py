"""Descriptive profiles of raw tables, classes and text lengths.

Lengths and class sizes are first reduced to one row per distinct value, so quantiles, histograms and
curves run on small tables however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators.prepare import all_present, category_of, non_empty_text
from labelloom.scale.joins import pin
from labelloom.schema import MIN_TEXT_LENGTH, NARRATIVE

# Report sizes, length limits and long-tail borders.
LENGTH_LIMITS = (128, 256, 384)
HEAD_ABOVE, TAIL_BELOW = 1000, 100
TOP_NULLS, TOP_BIAS, TOP_TOKENS = 20, 15, 40
CHAR_BINS, TOKEN_BINS = 50, 80


def _non_null_counts(df: DataFrame) -> DataFrame:
    """(column, non_null, total) rows from one aggregation."""
    counted = df.agg(F.count("*").alias("_total"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    return counted.unpivot(["_total"], list(df.columns), "column_name", "non_null_count")


def table_profile(df: DataFrame) -> DataFrame:
    """Name, type, non-null count and row count of every column."""
    entries = [x for name, kind in df.dtypes for x in (F.lit(name), F.lit(kind))]
    return _non_null_counts(df).select(
        "column_name",
        F.create_map(*entries)[F.col("column_name")].alias("column_type"),
        "non_null_count",
        F.col("_total").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
    )


def null_share_top(df: DataFrame, k: int = TOP_NULLS) -> DataFrame:
    """Percent of nulls per column, largest first."""
    share = 100.0 * F.try_divide(F.col("_total") - F.col("non_null_count"), F.col("_total"))
    return (
        _non_null_counts(df)
        .select("column_name", share.alias("null_percent"))
        .orderBy(F.desc("null_percent"), "column_name")
        .limit(k)
    )


def duplicate_share(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of rows equal to an earlier row; nulls equal nulls.

    Rows are compared by a SHA-256 of their JSON form, in which a null differs from every value, so the
    shuffle carries digests with partial counts rather than rows.
    """
    row = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
    groups = df.groupBy(F.sha2(row, 256).alias("_row")).agg(F.count("*").alias("_n"))
    repeated = F.coalesce(F.try_divide(F.sum(F.col("_n") - 1).cast("double"), F.sum("_n")), F.lit(0.0))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), repeated.alias("duplicate_share"))


def yearly_counts(df: DataFrame, date_column: str) -> DataFrame:
    """Rows per year; dates that do not parse are left out. Columns of a date or time type are taken as they are."""
    typed = dict(df.dtypes)[date_column] in ("date", "timestamp", "timestamp_ntz")
    day = F.col(date_column) if typed else F.try_to_timestamp(F.col(date_column).cast("string"))
    year = F.year(day).cast("long")
    return (
        df.select(year.alias("year"))
        .filter("year is not null")
        .groupBy("year")
        .agg(F.count("*").alias("n_rows"))
        .orderBy("year")
    )


def text_availability(df: DataFrame, text: str = NARRATIVE) -> DataFrame:
    """Rows with and without text, and their share."""
    counts = pin(df.groupBy(F.col(text).isNull().alias("text_missing")).agg(F.count("*").alias("n_rows")), "texts")
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.withColumn("share", F.try_divide(F.col("n_rows"), total))


def selection_bias(df: DataFrame, text: str = NARRATIVE, product: str = "product", k: int = TOP_BIAS) -> DataFrame:
    """Share of each product among all rows and among rows with text; a side without rows stays null."""
    has_text = F.col(text).isNotNull() & T.has_text(F.col(text))
    counts = pin(
        df.filter(F.col(product).isNotNull())
        .groupBy(product)
        .agg(F.count("*").alias("raw"), F.count_if(has_text).alias("with_text")),
        "products",
    )
    raw_total, text_total = counts.agg(F.sum("raw")).scalar(), counts.agg(F.sum("with_text")).scalar()
    shares = counts.select(
        product,
        F.try_divide(F.nullif(F.col("raw"), F.lit(0)), raw_total).alias("raw_share"),
        F.try_divide(F.nullif(F.col("with_text"), F.lit(0)), text_total).alias("text_share"),
    )
    delta = F.col("text_share") - F.col("raw_share")
    return shares.withColumn("delta", delta).orderBy(F.desc_nulls_last("delta"), product).limit(k)


def eda_slice(df: DataFrame, limit: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Rows with text, product and issue whose unstripped text is longer than ``limit``, plus category."""
    kept = non_empty_text(df).filter(all_present(["product", "issue"]) & (F.length(NARRATIVE) > limit))
    return kept.withColumn("category", category_of(F.col("product"), F.col("issue")))


# --- numbers reduced to (value, n) ------------------------------------------------


def value_counts(df: DataFrame, value: Column) -> DataFrame:
    """One row per distinct non-null value with its count."""
    return (
        df.select(value.cast("long").alias("value"))
        .filter("value is not null")
        .groupBy("value")
        .agg(F.count("*").alias("n"))
    )


def text_lengths(df: DataFrame, text: str = NARRATIVE) -> DataFrame:
    return value_counts(df, F.length(text))


def token_lengths(df: DataFrame, text: str = NARRATIVE) -> DataFrame:
    return value_counts(df, F.size(T.simple_tokenize(F.col(text))))


def _quantile(q: float) -> Column:
    return F.percentile("value", F.lit(q), F.col("n"))


def describe(counts: DataFrame) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear), max of the values behind ``counts``.

    The spread is summed around the mean, which is taken first, so it does not cancel for large values.
    """
    counts = pin(counts, "values")
    value, n = F.col("value").cast("double"), F.col("n")
    total, first = F.sum(n), F.sum(value * n)
    mean = counts.agg(first / total).scalar()
    spread = F.when(total > 1, F.sqrt(F.sum(n * (value - mean) * (value - mean)) / (total - 1)))
    return counts.agg(
        F.coalesce(total, F.lit(0)).alias("count"),
        (first / total).alias("mean"),
        spread.alias("std"),
        F.min(value).alias("min"),
        _quantile(0.25).alias("q25"),
        _quantile(0.5).alias("q50"),
        _quantile(0.75).alias("q75"),
        F.max(value).alias("max"),
    )


def length_describe(df: DataFrame, text: str = NARRATIVE) -> DataFrame:
    return describe(text_lengths(df, text))


def histogram(counts: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins from the least to the greatest value, the last one closed; empty bins are absent."""
    counts = pin(counts, "lengths")
    low, high = counts.agg(F.min("value")).scalar(), counts.agg(F.max("value")).scalar()
    position = F.try_divide((F.col("value") - low).cast("double"), (high - low).cast("double")) * bins
    at = F.least(F.floor(F.coalesce(position, F.lit(0.0))), F.lit(bins - 1)).cast("long")
    return counts.groupBy(at.alias("bin")).agg(F.sum("n").alias("n_rows"), F.min("value").alias("least"))


def length_histogram(df: DataFrame, text: str = NARRATIVE, bins: int = CHAR_BINS) -> DataFrame:
    return histogram(text_lengths(df, text), bins)


def token_length_histogram(
    df: DataFrame, text: str = NARRATIVE, bins: int = TOKEN_BINS, clip: float = 0.995
) -> DataFrame:
    """Bins of token lengths; ``shown`` is false for bins that start beyond the ``clip`` quantile."""
    counts = pin(token_lengths(df, text), "lengths")
    return histogram(counts, bins).withColumn("shown", F.col("least") <= counts.agg(_quantile(clip)).scalar())


def token_length_stats(df: DataFrame, text: str = NARRATIVE) -> DataFrame:
    """Extremes, quantiles and shares above fixed limits, as (metric, value) rows."""
    counts = token_lengths(df, text)

    def above(limit: int) -> Column:
        return 100.0 * F.try_divide(F.sum(F.when(F.col("value") > limit, F.col("n")).otherwise(0)), F.sum("n"))

    metrics = {
        "min": F.min("value").cast("double"),
        "max": F.max("value").cast("double"),
        "median": _quantile(0.5),
        "p90": _quantile(0.9),
        "p95": _quantile(0.95),
        "p99": _quantile(0.99),
        **{f"% > {limit}": above(limit) for limit in LENGTH_LIMITS},
    }
    wide = counts.agg(*[column.alias(name) for name, column in metrics.items()])
    return wide.unpivot([], [F.col(f"`{name}`") for name in metrics], "metric", "value")


# --- classes ------------------------------------------------------------------------


def class_count_describe(df: DataFrame, label: str = "category") -> DataFrame:
    """Number of classes, rows without a class, and the description of class sizes."""
    sizes = pin(df.groupBy(label).agg(F.count("*").alias("value")), "classes")
    known = sizes.filter(F.col(label).isNotNull()).select("value", F.lit(1).cast("long").alias("n"))
    missing = sizes.agg(F.coalesce(F.sum(F.when(F.col(label).isNull(), F.col("value"))), F.lit(0))).scalar()
    return describe(known).select(
        F.col("count").alias("n_classes"),
        missing.alias("n_missing"),
        *[F.col(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")],
    )


def longtail_buckets(df: DataFrame, label: str = "category") -> DataFrame:
    """Classes above 1000 rows, from 100 to 1000, and below 100."""
    n = F.col("n")
    return (
        df.groupBy(label)
        .agg(F.count("*").alias("n"))
        .agg(
            F.count_if(n > HEAD_ABOVE).alias("head_gt_1000"),
            F.count_if((n >= TAIL_BELOW) & (n <= HEAD_ABOVE)).alias("mid_100_1000"),
            F.count_if(n < TAIL_BELOW).alias("tail_lt_100"),
        )
    )


def longtail_curve(df: DataFrame, label: str = "category") -> DataFrame:
    """Class sizes by rank. The window runs over the class table, one row per class."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    order = Window.orderBy(F.desc("n_rows"), label)
    return sizes.select(F.row_number().over(order).cast("long").alias("class_rank"), label, "n_rows")


# --- tokens and patterns ----------------------------------------------------------


def top_tokens(df: DataFrame, k: int = TOP_TOKENS, text: str = NARRATIVE) -> DataFrame:
    """Most frequent letter runs of all texts."""
    counts = (
        df.select(F.explode(T.alpha_tokens(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("freq"))
    )
    return counts.orderBy(F.desc("freq"), "token").limit(k)


def pattern_shares(df: DataFrame, text: str = NARRATIVE) -> DataFrame:
    """Share of texts with characters other than letters and spaces, and with anonymised runs."""
    return df.agg(
        T.pattern_share(F.col(text), T.NON_ALPHA_PATTERN).alias("non_alpha_share"),
        T.pattern_share(F.col(text), T.ANON_PATTERN).alias("anonymised_share"),
    )
