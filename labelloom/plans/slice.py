"""The whole preparation as one job: filters, class and conflict rules, ids and splits.

Texts are wide and may repeat heavily, so only one narrow row per record (id, digest, category, two
flags) takes part in grouping, ranking and numbering. The text is read once to build those rows and
once more at the end, joined on the unique record id, where no key can be hot.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators import prepare as P
from labelloom.operators import split as S
from labelloom.scale.joins import fits_broadcast, lookup_join, pin
from labelloom.scale.staging import stage
from labelloom.schema import (
    FINAL_COLUMNS,
    MIN_CLASS_COUNT,
    MIN_TEXT_LENGTH,
    NARRATIVE,
    RECORD_ID,
    REQUIRED_COLUMNS,
    SEED,
    require_columns,
)


class PreparedSlice:
    """Prepared complaints over ``raw``, a table of ``record_id`` (unique, orderable) and the raw columns."""

    def __init__(
        self,
        raw: DataFrame,
        min_text_length: int = MIN_TEXT_LENGTH,
        min_class_count: int = MIN_CLASS_COUNT,
        seed: int = SEED,
    ) -> None:
        self.raw = require_columns(raw, [RECORD_ID, *REQUIRED_COLUMNS])
        self.min_text_length = min_text_length
        self.min_class_count = min_class_count
        self.seed = seed

    @cached_property
    def marked(self) -> DataFrame:
        """One narrow row per raw record, rejected ones included so that the funnel needs no second scan."""
        complete = P.has_required()
        usable = complete & P.longer_than(F.col(NARRATIVE), self.min_text_length)
        category = P.category_of(F.col("product"), F.col("issue"))
        digest = T.key_digest(T.text_key(F.col(NARRATIVE)))
        return stage(
            P.select_required(self.raw)
            .select(RECORD_ID, "product", "issue", NARRATIVE, complete.alias("complete"), usable.alias("usable"))
            .select(
                RECORD_ID,
                "complete",
                "usable",
                F.when(F.col("usable"), category).alias("category"),
                F.when(F.col("usable"), digest).alias("key_digest"),
            ),
            "marked",
        )

    @cached_property
    def usable(self) -> DataFrame:
        return self.marked.filter("usable").select(RECORD_ID, "category", "key_digest")

    @cached_property
    def classes(self) -> DataFrame:
        """Size of every class before the class filter, with a number that stands for it in wide work."""
        number = F.row_number().over(Window.orderBy("category"))  # one row per class
        return pin(P.class_sizes(self.usable).withColumn("class_id", number), "classes")

    @cached_property
    def in_valid_class(self) -> DataFrame:
        """Records of the classes that are large enough: record id, digest and class number."""
        valid = self.classes.filter(F.col("class_rows") >= self.min_class_count)
        joined = lookup_join(self.usable, valid, "category", "inner", "class_rows", F.col(RECORD_ID))
        return joined.select(RECORD_ID, "class_id", "key_digest")

    @cached_property
    def keys(self) -> DataFrame:
        """One row per text key inside the valid classes."""
        return stage(P.key_groups(self.in_valid_class, "class_id"), "keys")

    @cached_property
    def classes_after_conflicts(self) -> DataFrame:
        clean = self.keys.filter(~F.col("conflicting"))
        sizes = clean.groupBy("class_id").agg(F.sum("key_rows").alias("class_rows"))
        return pin(sizes.join(self.classes.select("class_id", "category"), "class_id"), "classes")

    @cached_property
    def groups(self) -> DataFrame:
        """Surviving keys with their category and row count."""
        valid = self.classes_after_conflicts.filter(F.col("class_rows") >= self.min_class_count)
        clean = self.keys.filter(~F.col("conflicting")).select("key_digest", "class_id", "key_rows")
        joined = lookup_join(clean, valid, "class_id", "inner", "class_rows", F.col("key_digest"))
        return joined.select("key_digest", "category", "key_rows")

    @cached_property
    def group_splits(self) -> DataFrame:
        return stage(S.split_groups(self.groups, seed=self.seed), "splits")

    @cached_property
    def records(self) -> DataFrame:
        """Surviving records, narrow: record id, digest, category and split."""
        table = self.group_splits.select("key_digest", "key_rows", "category", "split")
        joined = lookup_join(self.in_valid_class, table, "key_digest", "inner", "key_rows", F.col(RECORD_ID))
        # Written once: numbering samples its input before it orders it, and the funnel reads it as well.
        return stage(joined.drop("key_rows"), "records")

    @cached_property
    def numbered(self) -> DataFrame:
        """``records`` with ``complaint_id``."""
        return P.assign_complaint_id(self.records)

    def _with_text(self, narrow: DataFrame) -> DataFrame:
        # Rejected rows are filtered where they are read, so that their texts are not shuffled.
        texts = P.min_text_length(P.drop_null_required(P.select_required(self.raw)), self.min_text_length)
        # The narrow rows are what a task keeps in memory; texts stream past them, so that they are not sorted and spilled.
        narrow = narrow.drop("class_id")
        held = F.broadcast(narrow) if fits_broadcast(self.records) else narrow.hint("shuffle_hash")
        return P.derive_text_key(held.join(texts, RECORD_ID))

    def rows(self) -> DataFrame:
        """The prepared table in its six final columns."""
        return P.select_final(self._with_text(self.numbered))

    def split_rows(self) -> DataFrame:
        """The prepared table plus ``split`` and the row key."""
        full = self._with_text(self.numbered)
        return full.select(RECORD_ID, *FINAL_COLUMNS, "key_digest", "split")

    def labelled(self) -> DataFrame:
        """Row key, category and split of the prepared rows: what needs no text, whose texts are not shuffled."""
        return self._with_text(self.records).select(RECORD_ID, "category", "split")

    def check(self) -> None:
        """Raise if any text key occurs in two splits."""
        S.assert_no_leakage(self.numbered)

    def funnel(self) -> DataFrame:
        """One row with the counts of every stage, from the narrow staged tables."""
        m = self.min_class_count
        zero = F.lit(0).cast("long")

        def total(column: str) -> F.Column:
            return F.coalesce(F.sum(column), zero)

        def at_least(column: str, value) -> F.Column:
            return F.coalesce(F.sum(F.when(F.col("class_rows") >= m, value)), zero).alias(column)

        rows = self.marked.agg(
            F.count("*").alias("rows_raw"),
            F.count_if("complete").alias("rows_after_na"),
            F.count_if("usable").alias("rows_after_min_len"),
        )
        smallest = F.coalesce(F.min(F.when(F.col("class_rows") >= m, F.col("class_rows"))), zero)
        before = self.classes.agg(
            F.count("*").alias("n_classes_before_min_count"),
            F.count_if(F.col("class_rows") >= m).alias("n_classes_after_min_count"),
            smallest.alias("min_class_size_after_filter"),
            at_least("rows_after_class_filter", F.col("class_rows")),
            at_least("rows_before_conflict_filter", F.col("class_rows")),
        )
        keys = self.keys.agg(
            F.count_if("conflicting").alias("n_conflicting_text_keys_before"),
            F.coalesce(F.sum(F.when(F.col("conflicting"), F.col("key_rows"))), zero).alias("dropped_conflict_rows"),
            F.coalesce(F.sum(F.when(~F.col("conflicting"), F.col("key_rows"))), zero).alias(
                "rows_after_conflict_filter"
            ),
        )
        after = self.classes_after_conflicts.agg(
            at_least("rows_after_class_refilter", F.col("class_rows")),
            at_least("rows_after_text_key", F.col("class_rows")),
            F.count_if(F.col("class_rows") >= m).alias("n_classes_after_refilter"),
            smallest.alias("min_class_size_after_refilter"),
        )
        left = P.remaining_conflicts(self.records, "class_id")
        stats = rows
        for part in (before, keys, after, left):
            stats = stats.join(part)  # one row each
        return stats.select(
            "*",
            zero.alias("dropped_by_text_dedup"),
            F.lit(m).cast("long").alias("min_class_count_threshold"),
        )


def prepare(raw: DataFrame) -> DataFrame:
    """Prepared complaints with default thresholds."""
    return PreparedSlice(raw).rows()
