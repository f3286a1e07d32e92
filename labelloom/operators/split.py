"""Leak-free train / val / test assignment, shuffling and split checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.scale.ordering import rank_in_group
from labelloom.schema import SEED, require_columns

FOLDS = 5


def _hash(salt: str, digest: str = "key_digest") -> Column:
    return F.md5(F.concat(F.lit(salt), F.col(digest)))


def _hex_number(hex_text: Column, digits: int) -> Column:
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("long")


def _ranked(groups: DataFrame, k: int, seed: int) -> DataFrame:
    """Rank of each key group in its category, largest first, and the fold its category starts at."""
    require_columns(groups, ["key_digest", "category", "key_rows"])
    hashed = groups.withColumn("_deal", _hash(f"{seed}|"))
    ranked = rank_in_group(hashed, "category", "key_rows", "_deal", "key_digest", "_rank")
    return ranked.drop("_deal").withColumn("_start", F.pmod(_hex_number(F.md5("category"), 4), F.lit(k)))


def group_stratified_folds(groups: DataFrame, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Deal the key groups of each category round-robin into ``k`` folds, largest groups first.

    ``groups`` has one row per ``key_digest`` with its ``category`` and ``key_rows``. A group lands in
    one fold as a whole, so folds never share a key; dealing by rank keeps class shares balanced.
    Each category starts at its own fold so that remainders do not all fall into fold 0.
    """
    fold = F.pmod(F.col("_rank") + F.col("_start"), F.lit(k)).cast("int")
    return _ranked(groups, k, seed).withColumn("fold", fold).drop("_rank", "_start")


def split_groups(groups: DataFrame, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``split``: fold 0 of the deal is test, fold 0 of a second deal of what remains is val.

    The second deal uses the same order, so its rank is the first rank less the test groups ahead of
    it; that number has a closed form, which saves sorting the groups a second time.
    """
    rank, start = F.col("_rank"), F.col("_start")
    tests_ahead = F.ceil((start + rank) / k) - F.ceil(start / k)
    is_test = F.pmod(rank + start, F.lit(k)) == 0
    is_val = F.pmod(rank - tests_ahead + start, F.lit(k)) == 0
    return (
        _ranked(groups, k, seed)
        .withColumn("split", F.when(is_test, "test").when(is_val, "val").otherwise("train"))
        .drop("_rank", "_start")
    )


def hash_group_split(df: DataFrame, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Split by the key hash alone: no shuffle at all, class shares balanced only in expectation."""
    outer = F.pmod(_hex_number(_hash(f"{seed}|o|"), 8), F.lit(k))
    inner = F.pmod(_hex_number(_hash(f"{seed}|i|"), 8), F.lit(k))
    return df.withColumn(
        "split", F.when(outer == 0, "test").when(inner == 0, "val").otherwise("train")
    )


def split_leakage(df: DataFrame, key: str = "key_digest") -> DataFrame:
    """Keys shared by each pair of splits, from one aggregation over the keys."""

    def seen_in(split: str) -> Column:
        return F.max((F.col("split") == split).cast("int")).alias(split)

    def shared(a: str, b: str) -> Column:
        return F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("long")

    flags = df.groupBy(key).agg(seen_in("train"), seen_in("val"), seen_in("test"))
    return flags.agg(
        shared("train", "val").alias("train_val"),
        shared("train", "test").alias("train_test"),
        shared("val", "test").alias("val_test"),
    )


def assert_no_leakage(df: DataFrame, key: str = "key_digest") -> None:
    overlap = split_leakage(df, key).first().asDict()
    if any(overlap.values()):
        raise ValueError(f"text keys are shared between splits: {overlap}")


def shuffle(df: DataFrame, id_column: str, seed: int = SEED) -> DataFrame:
    """Seeded permutation that does not depend on partitioning: sort by a hash of seed and id."""
    token = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")))
    return df.withColumn("shuffle_key", token).orderBy("shuffle_key", id_column)


def split_profile(df: DataFrame) -> DataFrame:
    """Rows and distinct classes of every split; (split, class) counts first, so nothing large is shuffled."""
    pairs = df.groupBy("split", "category").agg(F.count("*").alias("_rows"))
    return pairs.groupBy("split").agg(
        F.sum("_rows").alias("n_rows"), F.count("category").alias("n_classes")
    )


def unseen_labels(df: DataFrame, label: str = "category") -> DataFrame:
    """Labels that occur in val or test but not in train, with their row counts."""
    flags = df.groupBy("split", label).agg(F.count("*").alias("_rows"))
    seen = flags.filter(F.col("split") == "train").select(label)
    return (
        flags.filter(F.col("split") != "train")
        .join(seen, label, "left_anti")
        .select("split", label, F.col("_rows").alias("n_rows"))
    )


def assert_labels_seen(df: DataFrame, label: str = "category") -> None:
    """Raise if a label has no training row; the message gives their number and, as a report, the first twenty."""
    missing = unseen_labels(df, label).select(label).distinct()
    number = missing.count()
    if number:
        first = [row[label] for row in missing.orderBy(label).limit(20).collect()]
        raise ValueError(f"{number} labels without training rows, among them: {first}")
