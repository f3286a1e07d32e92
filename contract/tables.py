"""The driver tables seen as complaint tables, and results that several queries share."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import scores as SC
from labelloom.functions import text as T
from labelloom.operators import evaluate as E
from labelloom.operators import features as X
from labelloom.operators import prepare as P
from labelloom.plans.slice import PreparedSlice
from labelloom.scale.joins import lookup_join
from labelloom.scale.staging import stage
from labelloom.schema import NARRATIVE, RECORD_ID

# Appended to every text where a query is about cleaning: the driver texts hold no anonymised words.
SUFFIX = " XXXX 12/03 don't"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over the cores by id when the file has fewer splits than there are cores; a no-op on big tables."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, RECORD_ID) if df.rdd.getNumPartitions() < cores else df


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as complaints: language plays the product, source the issue."""
    named = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(RECORD_ID),
        F.col("text").alias(NARRATIVE),
        F.col("lang").alias("product"),
        F.col("source").alias("issue"),
    )
    return spread(named)


def marked_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """complaints with anonymised words, digits and a contraction in every text."""
    return complaints(spark, sf_dir).withColumn(NARRATIVE, F.concat(NARRATIVE, F.lit(SUFFIX)))


def gappy_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """complaints whose text is missing where no label row exists and whose issue is missing where toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(RECORD_ID), "quality", "toxic")
    joined = complaints(spark, sf_dir).join(labels, RECORD_ID, "left")
    return joined.select(
        RECORD_ID,
        F.when(F.col("quality").isNotNull(), F.col(NARRATIVE)).alias(NARRATIVE),
        "product",
        F.when(~F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("issue")).alias("issue"),
    )


class Shared:
    """Results one session computes at most once per data folder, each when it is first needed."""

    def __init__(self, raw: DataFrame) -> None:
        self.slice = PreparedSlice(raw)

    @cached_property
    def rows(self) -> DataFrame:
        full = self.slice.split_rows()
        # The text key is as long as the text and follows from it, so it is not written.
        return P.derive_text_key(stage(full.drop("text_key"), "prepared")).select(*full.columns)

    @cached_property
    def labelled(self) -> DataFrame:
        """The prepared rows without their texts; out of the whole rows where these are there already."""
        if "rows" in self.__dict__:
            return self.rows.select(RECORD_ID, "category", "split")
        return stage(self.slice.labelled(), "labelled")

    @cached_property
    def labels(self) -> DataFrame:
        return X.label_index(self.labelled.filter(F.col("split") == "train"))


_shared: dict[tuple[str, str], Shared] = {}


def shared(spark: SparkSession, sf_dir: str) -> Shared:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _shared:
        _shared[key] = Shared(complaints(spark, sf_dir))
    return _shared[key]


def shared_results() -> bool:
    """Whether any query has left results that others can use."""
    return bool(_shared)


def forget() -> None:
    """Drop shared results, so that the next query computes them again."""
    _shared.clear()


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared rows with their split."""
    return shared(spark, sf_dir).rows


def labelled(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Row key, category and split of the prepared rows, of the named splits if any are named."""
    rows = shared(spark, sf_dir).labelled
    return rows.filter(F.col("split").isin(*names)) if names else rows


def split_of(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return splits(spark, sf_dir).filter(F.col("split").isin(*names))


def stored_scores(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Deterministic per-class scores of every prepared row, as a stored model output would hold them.

    Score j is a hash fraction of (record, j), plus one half for the true class. The text is there if it is asked for.
    """
    rows = splits(spark, sf_dir).select(RECORD_ID, "category", NARRATIVE) if text else labelled(spark, sf_dir).drop("split")
    labels = shared(spark, sf_dir).labels
    k = labels.count()
    known = lookup_join(rows, labels, "category")

    def score(j):
        token = F.md5(F.concat_ws(":", F.col(RECORD_ID).cast("string"), j.cast("string")))
        part = F.conv(F.substring(token, 1, 6), 16, 10).cast("double") / 16777216.0
        return part + F.when(j == F.col("label_id"), 0.5).otherwise(0.0)

    return known.withColumn("scores", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), score))


def predictions(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """record_id, y_true, label_id, scores, proba, y_pred, and the text if it is asked for."""
    scored = stored_scores(spark, sf_dir, text).withColumn("_best", SC.argmax_index(F.col("scores")))
    named = shared(spark, sf_dir).labels.select(
        F.col("label_id").alias("_best"), F.col("category").alias("y_pred")
    )
    return (
        lookup_join(scored, named, "_best", "left")
        .withColumn("proba", SC.softmax(F.col("scores")))
        .withColumnRenamed("category", "y_true")
        .drop("_best")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion_pairs(predictions(spark, sf_dir))


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_of(spark, sf_dir, "train")


def mean_class_size(spark: SparkSession, sf_dir: str) -> int:
    """Average training rows per class, rounded up: the border between small and large classes."""
    sizes = labelled(spark, sf_dir, "train").groupBy("category").count()
    total, classes = sizes.agg(F.sum("count"), F.count("*")).first()
    return math.ceil(total / classes)


def frequency_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with borders scaled to the data; one size between mid and tail is left as a gap."""
    m = mean_class_size(spark, sf_dir)
    return E.class_frequency_groups(
        labelled(spark, sf_dir, "train"), head_min=math.ceil(1.5 * m), mid_min=m, tail_max=m - 2
    )


def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tail_classes(labelled(spark, sf_dir, "train"), mean_class_size(spark, sf_dir))


def terms_of(df: DataFrame, ngram_range: tuple[int, int] = (1, 2), analyzer: str = "word") -> DataFrame:
    return df.select(RECORD_ID, X.analyze(F.col(NARRATIVE), analyzer, ngram_range).alias("terms"))


def tokens_of(df: DataFrame, *keep: str) -> DataFrame:
    """Tokens of the marked texts."""
    marked = F.concat(F.col(NARRATIVE), F.lit(SUFFIX))
    return df.select(RECORD_ID, *keep, T.simple_tokenize(marked).alias("tokens"))
